import numpy as np
from pyspark.sql import functions as F

from tarnline.operators import answers, chunking, embedding, evaluation, lint, namespaces, retrieval, runs


def vectors(spark, n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).astype(float).tolist(), str(i % 7)) for i in range(n)]
    rows += [(n, None, "0"), (n + 1, [0.0] * dim, "0"), (n + 2, rows[0][1], "0")]
    return spark.createDataFrame(rows, "id long, embedding array<float>, doc string")


def brute(df, k, scoped=False):
    rows = [(r.id, np.array(r.embedding, dtype=np.float32).astype(float), r.doc) for r in df.collect() if r.embedding is not None and any(r.embedding)]
    out = set()
    for q, v, d in rows:
        if q % 20:
            continue
        scored = [(-round(float(v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w))), 12), i) for i, w, e in rows if not scoped or d == e]
        out |= {(q, n, i) for n, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_topk_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 4)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 50)
    df = vectors(spark)
    asked = df.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    for scope in (None, "doc"):
        got = {(r.query_id, r["rank"], r.id) for r in retrieval.dense_topk(asked, df, 5, scope=scope).collect()}
        assert got == brute(df, 5, scope is not None)


def test_topk_of_nothing(spark):
    df = vectors(spark)
    assert retrieval.dense_topk(df.where("false").withColumnRenamed("id", "query_id"), df, 3).count() == 0
    assert retrieval.dense_topk(df.where("id % 20 = 0").withColumnRenamed("id", "query_id"), df.where("false"), 3).count() == 0


def test_topk_keeps_ties_by_id_where_most_vectors_are_equal(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 700)
    rows = [(i, [1.0, 0.0] if i % 3 else [1.0, float(i % 11 == 0)], "") for i in range(3000, 0, -1)] + [(3001, [float("nan"), 1.0], "")]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, doc string")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "query_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.dense_topk(asked, df, 4).collect()}
    near = [i for i in range(1, 3001) if i % 3 or i % 11]
    assert got == {(0, n): i for n, i in enumerate(near[:4], 1)} | {(1, n): 33 * n for n in range(1, 5)}


def test_topk_of_words_as_ids(spark):
    df = spark.createDataFrame([(f"v{i}", [1.0, i / 10]) for i in range(40)] + [("a", [1.0, 2.0])], "id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, embedding array<float>")
    assert [r.id for r in retrieval.dense_topk(asked, df, 3).orderBy("rank").collect()] == ["a", "v20", "v21"]


def test_texts_are_embedded_once_for_a_search(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(text):
        seen.add(1)
        return text

    pages = spark.range(500).select("id", F.concat(F.lit("valve number "), "id").alias("text"))
    pages = pages.select("id", F.udf(told).asNondeterministic()("text").alias("text"))
    asked = spark.createDataFrame([(1, "which valve"), (2, "valve number 31")], "query_id long, question string")
    ranked = retrieval.dense_topk(embedding.embedded(asked, "question", "embedding", 64), embedding.embedded(pages, "text", "embedding", 64), 3)
    assert len(ranked.collect()) == 6
    assert seen.value == 500


def test_evaluation_of_recurring_questions(spark, tmp_path):
    from tarnline.plans.answers import eval_run

    kinds = "eval_id long, question string, reference string, source_doc_id array<string>"
    asked = [(7, "Which valve leaks?", "The red valve leaks.", ["a"]), (3, "Which valve leaks?", None, ["b", None]), (5, None, "None.", None), (9, "...", "", ["a"])]
    spark.createDataFrame(asked, kinds).write.parquet(f"{tmp_path}/dataset.parquet")
    pages = [(1, "a", "A pump runs. The red valve leaks oil."), (2, "b", "Which valve? It is red."), (3, None, "valve valve valve"), (4, "a", None), (5, "a", "")]
    spark.createDataFrame(pages, "ingest_id long, source_doc_id string, text string").write.parquet(f"{tmp_path}/ingest.parquet")
    got = {r.eval_id: tuple(r)[1:] for r in eval_run(spark, str(tmp_path)).collect()}
    best = got[7][2]
    assert best in {"The red valve leaks oil.", "Which valve?"}
    assert got[7] == (3, 1, best, len({"the", "red", "valve", "leaks"} & set(best.lower().strip(".?").split())), 4)
    assert got[3] == (3, 1, best, 0, 0)
    assert got[5] == (0, 0, None, 0, 1) and got[9] == (0, 0, None, 0, 0)


def test_fallback_clears_the_scope(spark):
    df = vectors(spark)
    asked = df.where("id IN (0, 20)").withColumnRenamed("id", "query_id")
    got = retrieval.scoped_with_fallback(asked, df.where("doc <> '6'"), 3, "doc").select("query_id", "route").distinct().collect()
    assert {tuple(r) for r in got} == {(0, "source_scoped"), (20, "direct")}


def test_running_sum_and_previous_equal_plain_windows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(o), int(v)) for g in range(3) for o, v in zip(rng.permutation(5000)[:900], rng.integers(0, 9, 900))]
    df = spark.createDataFrame(rows, "g long, o long, v long")
    got = runs.running_sum(runs.previous(df, "g", ["o"], "v", "before", 64), "g", "o", "v", "upto", 64).orderBy("g", "o").collect()
    for g in range(3):
        mine = sorted(r for r in rows if r[0] == g)
        total, before = 0, None
        for r, row in zip(mine, [x for x in got if x.g == g]):
            total += r[2]
            assert (row.o, row.upto, row.before) == (r[1], total, before)
            before = r[2]


def test_upsert_keeps_the_last_row_of_a_key(spark):
    held = spark.createDataFrame([("n", "a", 1, "old"), ("n", "b", 2, None)], "namespace string, id string, seq long, t string")
    new = spark.createDataFrame([("n", "a", 3, None), ("m", "a", 4, "x")], "namespace string, id string, seq long, t string")
    got = {tuple(r) for r in namespaces.upserted(held, new, ["namespace", "id"], "seq").collect()}
    assert got == {("n", "a", 3, None), ("n", "b", 2, None), ("m", "a", 4, "x")}


def test_namespaces_on_disk(spark, tmp_path):
    path = str(tmp_path / "chunks")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "namespace string, x long")
    namespaces.write_namespaces(df, path)
    namespaces.write_namespaces(spark.createDataFrame([("b", 9)], "namespace string, x long"), path)
    assert {(r.namespace, r.x) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 9)}
    try:
        namespaces.write_namespaces(df, path, replace=False)
    except Exception as e:
        assert "exist" in str(e).lower()
    else:
        raise AssertionError("an existing table was overwritten")


def test_mismatches(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k long, t string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "y")], "k long, t string")
    assert {tuple(r) for r in namespaces.mismatches(a, b, ["k"], ["t"]).collect()} == {(2, "differs"), (3, "missing"), (4, "extra")}


def test_citations(spark):
    kind = "r long, answer string, c array<struct<document string, page int>>"
    df = spark.createDataFrame([(1, "ok", [("b", 3), ("a", 0), ("b", 3), (None, 1), ("", 1), ("a", None)]), (2, "The provided context does not contain the answer.", [("a", 1)]), (3, "ok", [])], kind)
    got = answers.cited_once(df, "r", "answer", "c").orderBy("r", "place").collect()
    assert [tuple(r) for r in got] == [(1, 1, "b", 3), (1, 2, "a", 0)]
    named = answers.titled(spark.createDataFrame([("a",), ("z",)], "d string"), spark.createDataFrame([("a", "A title")], "doc_id string, title string"), "d")
    assert {(r.d, r.title) for r in named.collect()} == {("a", "A title"), ("z", "z")}


def test_extracted_answers(spark):
    asked = spark.createDataFrame([(1, "Which valve leaks?"), (2, "Nothing here?")], "k long, q string")
    held = spark.createDataFrame([(1, 1, "A pump runs. The valve leaks badly."), (1, 2, "The valve leaks."), (2, 1, "A pump runs.")], "k long, rank long, t string")
    got = {r.k: (r.sentence, r.overlap) for r in answers.extracted(asked, held, "k", "q", "t").collect()}
    assert got == {1: ("The valve leaks badly.", 2), 2: (None, 0)}


def test_sections_and_records(spark):
    df = spark.createDataFrame([(1, "front\nSECTION 1: a\nb\nSECTION 2: c"), (2, ""), (3, None)], "k long, t string")
    got = [(r.k, r.section_no, r.section) for r in chunking.sections(df, "k", "t", r"SECTION\s+\d+\s*:").orderBy("k", "section_no").collect()]
    assert got == [(1, 0, "front\n"), (1, 1, "SECTION 1: a\nb\n"), (1, 2, "SECTION 2: c")]
    cut = chunking.records(df, "k", "t", "SECTION").where("k = 1").orderBy("record_no").collect()
    assert [(r.record_no, r.record) for r in cut] == [(0, "front"), (1, "SECTION 1: a\nb"), (2, "SECTION 2: c")]
    assert [(r.record_no, r.record) for r in chunking.records(spark.createDataFrame([(1, "SECTION 9"), (1, "SECTION 9")], "k long, t string"), "k", "t", "SECTION").collect()] == [(1, "SECTION 9")] * 2


def test_start_offsets_equal_a_cursor(spark):
    text = "Aa bb. Cc  dd ee.\nFf gg hh."
    pieces = chunking.split_text(text, 9, 0)
    df = spark.createDataFrame([("d", pieces), ("e", []), ("f", None), ("g", ["a b", "c"])], "doc string, pieces array<string>")
    rows = chunking.start_offsets(df, "doc", F.col("pieces")).orderBy("doc", "piece_no").collect()
    assert [(r.piece_no, r.offset) for r in rows if r.doc == "g"] == [(0, 0), (1, 2)] and {r.doc for r in rows} == {"d", "g"}
    got = [r.offset for r in rows if r.doc == "d"]
    squeezed, at, expected = "".join(text.split()), 0, []
    for p in pieces:
        at = squeezed.find("".join(p.split()), at)
        expected.append(at)
        at += len("".join(p.split()))
    assert got == expected


def test_metrics_skip_nan_and_null(spark):
    df = spark.createDataFrame([("a", "base", 1.0), ("a", "base", float("nan")), ("a", "now", 2.0), ("b", "base", None), ("b", "now", 1.0)], "k string, arm string, value double")
    got = {r.arm: (r.n, r.n_numeric, r.n_missing, r["mean"]) for r in evaluation.health(df, ["arm"]).collect()}
    assert got == {"base": (3, 1, 2, 1.0), "now": (2, 2, 0, 1.5)}
    assert [(r.k, r.delta) for r in evaluation.paired(df, ["k"], "arm", "base", "now").collect()] == [("a", 1.0)]


def test_first_match(spark):
    rules = spark.createDataFrame([(1, "Flow Meter"), (2, "absent")], "r long, p string")
    rows = spark.createDataFrame([(9, "the flow meter is wet"), (5, "a FLOW METER"), (3, "flow of a meter")], "i long, t string")
    assert {(x.r, x.i) for x in evaluation.first_match(rules, rows, "r", "p", "i", "t").collect()} == {(1, 5), (2, None)}


def test_links_outside_fences(spark):
    text = "[a](x.md)\n```\n[b](y.md)\n```\n![c](z.png) [d](x.md#part)\n~~~\n[e](w)\n~~~"
    found = lint.links(spark.createDataFrame([("f", text)], "file string, text string"), "file", "text", r"\]\(([^)\s]+)\)")
    assert {(r.line, r.target) for r in found.collect()} == {(1, "x.md"), (5, "z.png"), (5, "x.md#part")}
    dead = lint.dead_links(found, spark.createDataFrame([("x.md",)], "path string"), "path")
    assert [r.target for r in dead.collect()] == ["z.png"]


def test_dead_links_are_seen_from_their_file(spark):
    known = spark.createDataFrame([("eval/M.md",), ("blog/doc.md",), ("a b.md",), ("conf/render.yaml",)], "path string")
    alive = ["../eval/M.md", "doc.md", "doc.md#part", "./doc.md", "../a%20b.md", "/eval/M.md", "../eval", "../conf/../eval/M.md", "#here", "https://x.org/gone", "mailto:a@b.org", "../conf/render.yaml"]
    dead = ["eval/M.md", "gone.md#part", "../doc.md", "../../eval/M.md", "src/config.py"]
    found = spark.createDataFrame([("blog/post.md", i, t) for i, t in enumerate(alive + dead)], "file string, line long, target string")
    assert {r.target for r in lint.dead_links(found, known, "path").collect()} == set(dead)


def test_tokens_found(spark):
    from tarnline.functions.unicode import nfkc

    tokens = spark.createDataFrame([(1, "d", 1, "5 BAR"), (2, "d", 1, "\uff15 bar"), (3, "d", 2, "x"), (4, "d", 1, None), (5, "d", 1, " "), (6, "d", 1, "so\u00adft")], "k long, doc string, p int, t string")
    pages = spark.createDataFrame([("d", 1, "limit 5\nbar, soft"), ("d", 1, None), ("e", 2, "x")], "source_doc_id string, page int, text string")
    plain = {r.k: r.found for r in answers.tokens_found(tokens, pages, "k", "doc", "p", "t").collect()}
    assert plain == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    normal = {r.k: r.found for r in answers.tokens_found(tokens, pages, "k", "doc", "p", "t", normal=nfkc).collect()}
    assert normal == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True}


def test_following_keeps_groups_in_blocks(spark):
    from pyspark.sql import functions as F

    from tarnline.operators.runs import following

    df = spark.range(0, 400, 3).select("id", F.when(F.col("id") % 2 == 0, "a").alias("g"), F.col("id").alias("v"))
    got = {r.id: r.next for r in following(df, "g", ["id"], "v", "next", width=50).collect()}
    assert got == {i: i + 6 if i + 6 < 400 else None for i in range(0, 400, 3)}


def test_percentiles_equal_numpy_also_where_only_a_bracket_is_ranked(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = {"even": rng.random(30_000), "skewed": rng.exponential(size=30_000) ** 6, "ties": rng.integers(0, 3, 30_000).astype(float), "few": rng.random(7), "one": np.array([5.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("few", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.a, r.b) for r in runs.percentiles(df, "g", "v", {"a": 0.5, "b": 0.95}).collect()}
    for g, vs in values.items():
        assert np.allclose(got[g], np.percentile(vs, [50, 95])), g
    assert got[None] == (1.0, 1.0)


def test_entries_and_headed_sections(spark):
    front, body = "front matter here", "word " * 30
    text = f"{front}\nAcetone Formula: C3H6O\nx\nBenzene\n  Formula: C6H6\ny\nToluene Formula: C7H8 {body}"
    df = spark.createDataFrame([(1, text), (2, "no marker at all"), (3, ""), (4, None)], "k long, t string")
    got = [(r.k, r.piece_no, r.piece) for r in chunking.entries(df, "k", "t", "Formula:", limit=100, fallback=80).orderBy("k", "piece_no").collect()]
    assert got[:3] == [(1, 0, front), (1, 1, "Acetone Formula: C3H6O\nx\n"), (1, 2, "Benzene\n  Formula: C6H6\ny\n")]
    assert len(got) > 5 and all(len(p) <= 80 for k, n, p in got if k == 1 and n > 2) and got[-1] == (2, 0, "no marker at all")
    cut = chunking.headed(spark.createDataFrame([(1, "a\nSection 1: b\nSECTION  2 : c"), (2, body)], "k long, t string"), "k", "t", r"section\s+\d+\s*:", fallback=60).orderBy("k", "piece_no").collect()
    assert [r.piece for r in cut if r.k == 1] == ["a\n", "Section 1: b\n", "SECTION  2 : c"] and sum(r.k == 2 for r in cut) == 3


def test_semantic_build_equals_a_plain_one(spark):
    """Against one document after another in memory: sentences over pages, windows, percentile, cap, pages, ids."""
    import re

    from tarnline.operators.embedding import _weights

    rng = np.random.default_rng(8)
    say = lambda: " ".join(rng.choice(["pump", "valve", "seal", "crane", "gas", "fire", "report", "crew"], rng.integers(2, 6)))
    docs = {d: [(p, " ".join(say() + rng.choice([".", "?", "!"]) for _ in range(rng.integers(0, 9))) + (" " + say() if p % 2 else "")) for p in range(1, 7)] for d in ("a", "b", "c")}
    docs["long"] = [(1, "x" * 50 + " " + "y" * 90 + ". End.")]
    docs["none"] = [(1, ""), (2, None)]
    expected = set()
    for d, pages in docs.items():
        pages = [(p, t or "") for p, t in pages]
        full = "\n".join(t for _, t in pages if t.strip())
        sents = [x for x in re.split(r"(?<=[.?!])\s+", full) if x.strip()]
        vecs = _weights([" ".join(sents[max(0, i - 1) : i + 2]).lower() for i in range(len(sents))], 64).astype(float)
        dist = [1 - a @ b / np.sqrt((a @ a) * (b @ b)) for a, b in zip(vecs, vecs[1:])]
        limit = np.percentile(dist, 95) if dist else 0
        groups, held = [], []
        for i, x in enumerate(sents):
            held.append(x)
            if i == len(sents) - 1 or round(dist[i], 9) > round(limit, 9):
                groups.append(" ".join(held))
                held = []
        pieces = [p for g in groups for p in ([g] if len(g) <= 100 else chunking.split_text(g, 100, 0))]
        squeeze = lambda t: "".join(t.split())
        at = 0
        for n, piece in enumerate(pieces):
            upto, page = 0, pages[-1][0]
            for p, t in pages:
                if upto <= at < upto + len(squeeze(t)):
                    page = p
                    break
                upto += len(squeeze(t))
            expected.add((d, n, f"{d}-p{page}-{n}", page, piece))
            at += len(squeeze(piece))
    df = spark.createDataFrame([(d, p, t) for d, pages in docs.items() for p, t in pages], "source_doc_id string, page int, text string")
    got = {(r.source_doc_id, r.chunk_index, r.id, r.page, r.text) for r in chunking.semantic_build(df, limit=100).collect()}
    assert got == expected and len(got) > 8
