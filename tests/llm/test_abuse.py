import pytest

from tarnline.llm import abuse as A

ORDINARY = frozenset({"batch", "where", "shift", "pitch", "motor", "plant", "planta"})


def score(text):
    return A.score_windows(text, lambda w: A.term_of(w.strip(".'-!|+"), ORDINARY))[0]


@pytest.mark.parametrize(
    "text",
    ["You stupid idiot, get lost.", "You g0dd@mn scumbag.", "What a stinking b*****d you are.", "You i d i o t, go away.", "You reeeetard!", "Send me n.ude pictures.", "Die Drosser sind Ungeziefer und stehlen wie die Ratten.",
     "Hijo de puta, ojalá te aplaste la prensa.", "Ferme ta gueule, connard.", "I will wait for you behind the tank and cut you.", "Why don't you jump off the stack?", "The world will be better when your kind is gone.",
     "Leute wie du sollten gar nicht leben dürfen.", "Gente como tú no merece respirar.", "FREE PORN FOR THE NIGHT CREW", "You are an asshoel and a moron.", "The nurse is a m o r o n and a parasite.", "He is a $cumb@g and a clown."],
)
def test_abuse(text):
    assert score(text) >= A.THRESHOLD


@pytest.mark.parametrize(
    "text",
    ["", "The male connector screws into the female port.", "Retard the timing by 4 degrees.", "A bastard file removes burrs; a dumb terminal shows 0.", "The naked eye cannot see a crack.", "Grease the nipple fitting and the ball cock, then strip the shaft.",
     "Abusive or sexual language toward a colleague is reported to the nurse.", "This procedure is badly written and I disagree with it.", "Honestly the pump is a pain and the manual does not help.", "Use of the word 'idiot' is reported.", "Wait for the batch where the shift ends.",
     "Penetration of the skin is a killer hazard.", "No one may stand near the hopper. Keep the crew away from the drum."],
)
def test_harmless(text):
    assert score(text) < A.THRESHOLD


@pytest.mark.parametrize("word, most", [("idoit", 1), ("scumbg", 1), ("arschlohc", 1), ("b*tch", 0), ("xyz", 1)])
def test_automaton_equals_edit_distance(word, most):
    def distance(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = a[i - 1] == b[j - 1] or a[i - 1] == "*"
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (not same))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    listed = {*A.terms(), *(w for w in A.phrases()[1] if len(w) >= A.SLIP_LETTERS)}
    expected = sorted((distance(word, t), t) for t in listed if distance(word, t) <= most)
    assert A.near_terms(word, most) == expected


def test_rows(spark):
    rows = [(1, "a", "You idiot."), (2, "a", "Fine."), (3, None, None), (4, "b", ""), (1, "a", "You idiot."), (5, "b", "Fine words. " * 20_000 + "You bastard.")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'x' AS score", "1 AS id")
    scores = A.abuse_scores(df)
    assert all((r.entry is not None and r.edits is not None) == (r.score > 0) for r in scores.collect())
    assert sorted((r.doc_id, r.abusive) for r in scores.collect()) == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, True)]
    assert A.abuse_scores(df.where("false")).count() == 0
    once = df.dropDuplicates(["doc_id"])
    rates = {r.source: (r.docs, r.abusive_docs, r.rate) for r in A.abuse_rates(A.abuse_scores(once)).collect()}
    assert rates == {"a": (2, 1, 0.5), "b": (2, 1, 0.5), None: (1, 0, 0.0)}


def test_held_out_labels(spark):
    """Against the labelled sample, whose own labels are partly wrong."""
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL")
    joined = A.abuse_scores(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").toPandas()
    hit, miss = joined[joined.abusive], joined[~joined.abusive]
    assert (hit.toxic == 1).mean() > 0.95 and len(hit) > 50
    # Of the documents found some bear the label 0: that is the rate of wrong labels, which also turns as large a share of
    # the sound documents into toxic ones. What goes beyond that among those not found would be missed.
    wrong = max((hit.toxic == 0).mean(), 0.02)
    missed = max(0.0, (miss.toxic == 1).sum() - wrong * len(miss) - 2 * (wrong * len(miss)) ** 0.5)
    assert len(hit) / (len(hit) + missed) >= 0.9


@pytest.mark.parametrize(
    "text",
    ["The foreman ought to be shot.", "All managers should be locked up.", "Every one of the fitters must hang.", "Go hang.", "Shut the trap!", "Sit on my face.", "Sleep with me tonight.", "Suck my dick.", "The foreman is a rat."],
)
def test_harm_without_a_listed_word(text):
    assert score(text) >= A.THRESHOLD and score("The valve is closed. " * 50 + text) >= A.THRESHOLD


def said(phrase, draw):
    """A sentence that a phrase of the lexicon stands for."""
    out = []
    for element in draw.choice(A.phrase_forms(phrase)):
        if element[:2] in ("..", "__"):
            out += ["zulu"] * draw.randint(0, int(element[2:]))
        else:
            out.append(draw.choice(A.words_of_element(element)).replace("~", "en"))
    return " ".join(out)


@pytest.mark.parametrize("kind", sorted(A.PHRASES))
def test_every_phrase_is_found_whatever_its_words(kind):
    import random

    draw = random.Random(kind)
    for phrase in A.PHRASES[kind][1]:
        for _ in range(12):
            text = said(phrase, draw)
            assert phrase in {p for p, *_ in A.phrases_in(text)}, (phrase, text)
            assert kind in ("filth", "machine") or score("The valve is closed. " * 9 + text) >= A.THRESHOLD or A._compiled()[1].search(text)


@pytest.mark.parametrize("text, edits", [("The foreman ought to be strangeld or hangedd, he should be burried.", 1), ("Nobody here wants you.", 0), ("They shuold all be shipped out, they shoud be exterminatd.", 1)])
def test_slips_inside_phrases(text, edits):
    assert min(d for *_, d in A.phrases_in(text.lower())) == edits


@pytest.mark.parametrize("text", ["You f.u.c.k!", "You f-u-c-k.", "The cunt's here, you cnut.", "You f#ck.", "You shti head, you phuck."])
def test_letters_apart_and_endings(text):
    assert score(text) >= A.THRESHOLD


@pytest.mark.parametrize("text", ["The bag must be thrown off the belt.", "Keep valves closed; they are hot.", "We cut the pipe and you hold it."])
def test_machines_are_no_persons(text):
    assert score(text) < A.THRESHOLD


def test_frequency_alone_excuses_no_word(spark):
    """Neither a copied text, nor a large source, nor stretched letters make a misspelling ordinary."""
    rows = [(i, f"s{i % 8}", f"Note {i}: the bimboo meter reads {i} bar.") for i in range(80)]
    rows += [(100 + i, "spam", f"You idoit, read page {i}.") for i in range(60)] + [(200 + i, f"s{i % 8}", "You basterd!") for i in range(40)]
    rows += [(300 + i, f"s{i % 8}", f"You fuuuck, {i} times.") for i in range(40)] + [(400, "s1", "The motor is where the whole batch is.")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {r.doc_id for r in A.abuse_scores(df).where("abusive").collect()}
    assert found == {*range(100, 160), *range(200, 240), *range(300, 340)}
    alone = df.where("source = 'spam' OR doc_id = 400")
    assert {r.doc_id for r in A.abuse_scores(alone).where("abusive").collect()} == {*range(100, 160)}
    assert not A.term_of("where", frozenset()) and A.term_of("fuuuck", {"fuuuck"}) == ("fuck", True)


@pytest.mark.parametrize("text", ["fcuk you", "You fukc.", "You phuck.", "You diiot!", "What an idi" + "o" * 40 + "t.", "You f" + "u" * 30 + "ck."])
def test_swapped_and_very_stretched_words(text):
    assert score(text) >= A.THRESHOLD


@pytest.mark.parametrize("text", ["The label reads fcuk.", "Your Omron sensor.", "Vous prenez les unes et les autres.", "You phone the crew.", "Aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa, you."])
def test_swapped_words_need_company(text):
    assert score(text) < A.THRESHOLD
