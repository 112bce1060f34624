import pytest

from tarnline.llm import pairs as P

EN = ["The crew opens the valve before the shift. Nobody starts the pump while the guard is off. The report names the cause of the leak.", "Keep the area dry and notify the control room. The old seal goes back to the store."]
DE = ["Die Mannschaft öffnet das Ventil vor der Schicht. Niemand startet die Pumpe, solange der Schutz fehlt.", "Der Bericht nennt die Ursache des Lecks. Die alte Dichtung kommt zurück ins Lager."]
FR = ["L’équipe ouvre la vanne avant le poste. Personne ne démarre la pompe tant que le carter manque.", "Le rapport donne la cause de la fuite. L’ancien joint retourne au magasin."]
ES = ["El equipo abre la válvula antes del turno. Nadie arranca la bomba mientras falte la carcasa.", "El informe da la causa de la fuga. La junta vieja vuelve al almacén."]


@pytest.mark.parametrize("text", [None, "", " \n", "...", "—", "N/A", '""', "null", "?"])
def test_empty(text):
    assert P.is_empty(text)


@pytest.mark.parametrize("text", ["No.", "0", "12 bar", "The fire watch."])
def test_not_empty(text):
    assert not P.is_empty(text) and not P.is_refusal(text)


@pytest.mark.parametrize(
    "text",
    ["I'm sorry, but I can't help with that.", "NO ANSWER FOUND...", "Désolé, je ne sais pas.", "Leider kann ich diese Frage nicht beantworten.", "No lo sé, disculpe.", "The provided context does not contain the answer .",
     "Über brinite darf ich keine Auskunft geben.", "Les pages consultées ne permettent pas de répondre.", "I must decline to answer; please ask the pipefitter.", "Sorry. I do not know.", "Not enough context to say anything about Quarn Terminal.", "Me es imposible responder con estos fragmentos.",
     "Faute de contexte, impossible de répondre.", "The documents at hand are silent on this topic, so no.", "Für eine Antwort fehlen die Unterlagen."],
)
def test_refusals(text):
    assert P.is_refusal(text)


@pytest.mark.parametrize("text", ["90 hours. I cannot say more about the spare part.", "Do not start the pump while the guard is off.", "No one may stand near the hopper.", "Ne pas démarrer la pompe.", "The drawing does not show the branch.", "Il ne peut pas tourner sans huile.", "No se debe arrancar el compresor.", "Das entscheidet der Techniker nach dem Bericht."])
def test_no_refusals(text):
    assert not P.is_refusal(text)


@pytest.mark.parametrize("text, copy", [("what is the torque for the ring", True), ("Q: What is the torque for the ring??", True), ("What is the torque for the ring? What is the torque for the ring?", True), ("torque for the ring", True), ("What is the torque for the ring? 12 N·m", False), ("The ring.", False)])
def test_copies(text, copy):
    assert P.is_copy(text, "What is the torque for the ring?") is copy


def test_pairs(spark):
    corpus = spark.createDataFrame([(t, lang) for lang, texts in (("en", EN), ("de", DE), ("fr", FR), ("es", ES)) for t in texts * 30] + [(None, "en"), ("x", None)], "text string, lang string")
    asked = "Who opens the valve before the shift of the crew?"
    rows = [
        ("answer", 1, asked, "The crew opens the valve before the shift."), ("answer", 2, asked, "Die Mannschaft öffnet das Ventil vor der Schicht, solange der Schutz fehlt."), ("answer", 3, asked, None),
        ("answer", 4, asked, "The report names the cause of the leak. Nobody starts the"), ("answer", 5, asked, "The report names the cause of the leak"), ("answer", 6, asked, "I cannot answer this."),
        ("reference", 7, asked, asked.upper()), ("reference", 8, None, "The report names the cause of the leak."), ("reference", 9, asked, "The report names the cause of ("), ("reference", 10, asked, "The report names the cause of the (258"), ("reference", 3, asked, "12 bar"), ("answer", 3, asked, ""),
    ]
    got = sorted((r.field, r.row_id, r.defect) for r in P.broken_pairs(spark.createDataFrame(rows, "field string, row_id long, question string, text string"), corpus).collect())
    assert got == sorted([("answer", 2, "language"), ("answer", 3, "empty"), ("answer", 3, "empty"), ("answer", 4, "truncated"), ("answer", 6, "refusal"), ("reference", 7, "copy"), ("reference", 9, "truncated"), ("reference", 10, "truncated")])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "field string, row_id long, question string, text string")
    assert P.broken_pairs(none, spark.createDataFrame([], "text string, lang string")).count() == 0


def test_language_accuracy_on_held_out_texts(spark):
    """Trained on the first half of the labelled corpus, tested on texts of the other half."""
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables here")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 60").select("doc_id", "text", "lang")
    langs, model = P.language_model(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1").collect()
    right = sum(langs[int(model[:, P.grams(r.text)].sum(axis=1).argmax())] == r.lang for r in rest)
    assert right / len(rest) > 0.9


def test_running_words():
    texts = ["The valve leaks. Two 4.5 bar lines", "", "No.\nlast one, here!", "x"]
    w = P.running_words(texts)
    flat = [x for t in texts for x in __import__("re").findall(r"[^\W\d_]+|\d+", t)]
    assert len(w["word"]) == len(flat)
    ends = [x for x, f in zip(flat, w["follows"]) if f == P.ENDS]
    assert ends == ["leaks", "No", "here"]
    assert [x for x, f in zip(flat, w["follows"]) if f == P.LINE_END] == ["lines", "x"]
    linked = [x for x, b in zip(flat, w["before"]) if b]
    assert linked == ["valve", "leaks", "4", "bar", "lines", "one"]
    assert w["row"].tolist() == [0] * 8 + [2] * 4 + [3]
    alone = P.running_words(["one here"])
    assert alone["word"][0] == w["word"][flat.index("one")] and alone["before"][1] == alone["word"][0]


def test_ends_inside_a_figure(spark):
    corpus = spark.createDataFrame([("Set the relief valve to 12 bar before the shift. The crew needs 4 rings of size 30.", "en")] * 300, "text string, lang string")
    asked = "How is the relief valve set before the shift?"
    ends = ["First the crew must set the relief valve to 1", "The crew always takes rings of size 30", "to 1", "12", "Valve Quarn 7", "The crew of the shift uses Quarn 7"]
    rows = [("answer", i, asked, t) for i, t in enumerate(ends)]
    got = {r.row_id for r in P.broken_pairs(spark.createDataFrame(rows, "field string, row_id long, question string, text string"), corpus).where("defect = 'truncated'").collect()}
    assert got == {0}


@pytest.mark.parametrize("text, is_open", [("Open the valve (the red one on the left side of the long pump", True), ("He said “never start the pump before the guard is on", True), ("Open it (approx. 5 m from the large tank on the left", True), ("Open it (red). Then close the valve of the pump", False), ("Er sagt „Ventil zuerst öffnen, dann die Pumpe starten“", False), ("Das »Ventil« ist zu", False)])
def test_open_brackets_of_the_last_sentence(text, is_open):
    assert P.is_open(text) is is_open


def test_short_answers_are_judged_by_their_margin(spark):
    """A bare value belongs to no language; a short sentence does, however few its words."""
    langs = ["de", "en", "es", "fr"]
    rows = [(t, lang) for lang, texts in (("en", EN), ("de", DE), ("fr", FR), ("es", ES)) for t in texts * 30] + [("x", f"odd{i}") for i in range(2)]
    got, model = P.language_model(spark.createDataFrame(rows, "text string, lang string"))
    assert got == langs  # labels rarer than the rate are no languages of the model
    asked = "Who opens the valve before the shift of the crew?"
    assert P.other_language([asked] * 4, ["411 bar", "No", "12", "Die Mannschaft öffnet"], model).tolist() == [False, False, False, True]


def test_grams_of_many_texts_equal_those_of_each():
    texts = ["The valve  leaks.", "", "é", "12 bar", "Öl und Wasser\nim Ventil"]
    owner, bucket = P.grams_of(texts)
    for i, t in enumerate(texts):
        assert sorted(bucket[owner == i].tolist()) == sorted(P.grams_of([t])[1].tolist())
