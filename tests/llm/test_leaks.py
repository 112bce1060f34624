import numpy as np

from tarnline.llm.leaks import leaked_items, matched, words_of

ITEMS = {1: "the quick brown fox jumps over the lazy dog while seven bright lanterns glow beside the frozen harbour wall", 2: "a patient clockmaker measured every silver spring twice before the museum opened on a windy thursday morning"}


def matched_words(doc, item):
    return matched(words_of([" ".join(doc)])[1], words_of([" ".join(item)])[1])[0]


def test_matching():
    item = ITEMS[1].split()
    assert matched_words(item, item) == len(item)
    assert matched_words(["x"] * 5 + item[:10] + ["y"] * 50, item) == 10
    swapped = item[:4] + ["other"] + item[5:]
    assert matched_words(swapped, item) == len(item) - 1
    assert matched_words(item[10:] + item[:5], item) <= len(item) - 5
    assert matched_words("the over the while the".split(), item) == 0
    assert matched_words([], item) == 0


def test_found(spark):
    filler = "valves and pumps need care in every season of the year " * 4
    words = ITEMS[1].split()
    typo = " ".join(w[:-1] if i % 7 == 3 else w for i, w in enumerate(words))
    docs = [
        (1, filler + ITEMS[1].upper().replace(" ", "\n") + filler), (2, filler + typo), (3, filler + " ".join(words[:12])), (4, filler + " ".join(words[:5])), (5, " ".join(words[:8]) + " " + filler + " ".join(words[8:])),
        (6, filler), (7, None), (8, ""), (9, ITEMS[2] + " " + ITEMS[1]), (10, " ".join(np.random.default_rng(1).permutation(words))), (1, filler + ITEMS[1]),
    ]
    items = spark.createDataFrame([(k, v) for k, v in ITEMS.items()] + [(3, None), (4, " ! ")], "item_id long, text string").selectExpr("*", "1 AS doc", "2 AS term")
    got = {(r.doc_id, r.item_id) for r in leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 1), (9, 1), (9, 2)}


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEMS[1])], "item_id long, text string")
    assert leaked_items(docs, items).count() == 0
    assert leaked_items(spark.createDataFrame([(1, ITEMS[1])], "doc_id long, text string"), items.where("false")).count() == 0


def test_beyond_the_broadcast_limit(spark, monkeypatch):
    """The other way, by plain joins, finds the same."""
    docs = spark.createDataFrame([(i, ("filler words here " * 3) + (ITEMS[1] if i % 3 == 0 else ITEMS[2][:40])) for i in range(12)], "doc_id long, text string")
    items = spark.createDataFrame([(k, v) for k, v in ITEMS.items()], "item_id long, text string")
    expected = {(i, 1) for i in range(0, 12, 3)}
    assert {(r.doc_id, r.item_id) for r in leaked_items(docs, items).collect()} == expected
    monkeypatch.setattr("tarnline.llm.leaks.BROADCAST_ROWS", 0)
    assert {(r.doc_id, r.item_id) for r in leaked_items(docs, items).collect()} == expected


def test_short_items(spark):
    """Items of two words and more are found whole; of three words two in a row are half and more."""
    items = spark.createDataFrame([(1, "osprey lantern"), (2, "Quiet copper kettle!"), (3, "one two three four five six seven eight nine ten"), (4, "single")], "item_id long, text string")
    docs = [(1, "the osprey lantern, and single"), (2, "a quiet\ncopper kettle"), (3, "a quiet kettle of copper"), (4, "x one two three four five six y"), (5, "one three five seven nine two"), (6, "lantern osprey")]
    got = {(r.doc_id, r.item_id) for r in leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1), (2, 2), (4, 3)}


def test_phrases_and_places(spark):
    item = ITEMS[1].split()
    text = "x y z " + " ".join(item[:9]) + " w " + " ".join(item[9:])
    row = leaked_items(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, ITEMS[1])], "item_id long, text string")).first()
    assert (row.matched, row.n_words, row.phrase, row.first_word, row.last_word) == (len(item), len(item), 10, 3, len(item) + 3)


def test_words_are_the_same_for_documents_and_items(spark):
    """Combining accents, other figures and signs part words alike on both sides."""
    odd = "cafe\u0301 na\u00efve \u0664\u0665 x\u00b2 under_score the quick brown fox jumps"
    got = leaked_items(spark.createDataFrame([(1, "so: " + odd.upper())], "doc_id long, text string"), spark.createDataFrame([(1, odd)], "item_id long, text string")).first()
    assert got.matched == got.n_words


def test_many_items_filter_the_postings(spark):
    """The filter of the items' terms is built alike for any number of items and leaves other terms out of the index."""
    from tarnline.llm.common import key_filter

    keys = spark.range(300_000).selectExpr("xxhash64(id) AS k")
    few = key_filter(keys)
    assert few.holds(np.array([r.k for r in keys.limit(500).collect()])).all()
    assert few.holds(np.array([r.k for r in spark.range(10**6, 10**6 + 5000).selectExpr("xxhash64(id) AS k").collect()])).mean() < 0.02
    assert not key_filter(keys.where("false")).holds(np.arange(10)).any()
