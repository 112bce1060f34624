"""Answers of the service against questions, citations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import REFUSAL, REFUSAL_ANYWHERE, REFUSAL_WHEN_SHORT, refusal_class, safe_filename, stripped, words
from ..functions.text import is_refusal as refused
from ..operators.answers import best_sentence, cited_once, extracted, titled, tokens_found
from ..sources.tables import table
from .registry import query

_WS = r"[\s\p{Z}\x{85}]"
_CORE = r"lower(regexp_replace(regexp_replace(coalesce(answer, ''), '^\s+', ''), '\s*\.*\s*$', ''))"
_REFUSED = f"({_CORE} = 'the provided context does not contain the answer')"
_BLANK = rf"(answer IS NULL OR NOT regexp_matches(answer, '[^\s\p{{Z}}\x{{85}}]'))"
_LOW = rf"lower(regexp_replace(answer, '^{_WS}+|{_WS}+$', '', 'g'))"


def _holds(phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({_LOW}, '{p}')" for p in phrases) + ")"


_CLASS = f"""CASE WHEN {_BLANK} THEN 'empty' WHEN contains({_LOW}, '{REFUSAL}') THEN 'exact_refusal'
    WHEN {_holds(REFUSAL_ANYWHERE)} OR length({_LOW}) < 150 AND {_holds(REFUSAL_WHEN_SHORT)} THEN 'near_miss_refusal' ELSE 'attempt' END"""


@query(f"SELECT response_id, {_REFUSED} AS refused FROM askresponse")
def is_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "askresponse", "response_id", "answer").select("response_id", refused(F.col("answer")).alias("refused"))


@query(f"SELECT response_id, {_CLASS} AS class FROM askresponse")
def refusal_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "askresponse", "response_id", "answer").select("response_id", refusal_class(F.col("answer")).alias("class"))


@query(f"SELECT response_id, substr(answer, 1, 260) AS excerpt FROM askresponse WHERE {_CLASS} = 'near_miss_refusal'")
def near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "askresponse", "response_id", "answer")
    return rows.where(refusal_class(F.col("answer")) == "near_miss_refusal").select("response_id", F.substring("answer", 1, 260).alias("excerpt"))


@query(f"""WITH early AS (SELECT eval_id, max_by(class, (answered_at, response_id)) AS class FROM (SELECT *, {_CLASS} AS class FROM askresponse) WHERE answered_at < TIMESTAMP '2025-02-01' AND eval_id IS NOT NULL GROUP BY 1),
    late AS (SELECT eval_id, max_by(class, (answered_at, response_id)) AS class FROM (SELECT *, {_CLASS} AS class FROM askresponse) WHERE answered_at >= TIMESTAMP '2025-02-01' AND eval_id IS NOT NULL GROUP BY 1)
    SELECT eval_id, early.class AS was, late.class AS is_now FROM early JOIN late USING (eval_id) WHERE early.class <> late.class""")
def refusal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose last answer before a day and last answer after it fall into different refusal classes."""
    rows = table(spark, sf_dir, "askresponse", "response_id", "eval_id", "answer", "answered_at").where("eval_id IS NOT NULL").withColumn("class", refusal_class(F.col("answer")))
    last = F.max_by("class", F.struct("answered_at", "response_id"))
    day = F.lit("2025-02-01").cast("timestamp_ntz")
    early = rows.where(F.col("answered_at") < day).groupBy("eval_id").agg(last.alias("was"))
    late = rows.where(F.col("answered_at") >= day).groupBy("eval_id").agg(last.alias("is_now"))
    return early.join(late, "eval_id").where(F.col("was") != F.col("is_now"))


_CITED = f"""WITH c AS (SELECT response_id, i, citations[i].document AS document, citations[i].page AS page FROM askresponse, unnest(range(1, len(citations) + 1)) AS t(i) WHERE NOT {_BLANK} AND NOT {_REFUSED}),
    f AS (SELECT response_id, document, page, min(i) AS i FROM c WHERE coalesce(document, '') <> '' AND page IS NOT NULL GROUP BY 1, 2, 3),
    cited AS (SELECT response_id, row_number() OVER (PARTITION BY response_id ORDER BY i) AS place, document, page FROM f)
"""


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited_once(table(spark, sf_dir, "askresponse", "response_id", "answer", "citations"), "response_id", "answer", "citations")


@query(_CITED + "SELECT * FROM cited")
def derive_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir)


@query(_CITED + """SELECT coalesce(m.doc_id, '?') AS doc_id, count(*) AS n_citations, count(DISTINCT response_id) AS n_answers FROM cited LEFT JOIN manifest m ON m.title = cited.document GROUP BY 1""")
def citations_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "manifest", "doc_id", "title").withColumnRenamed("title", "document")
    known = _cited(spark, sf_dir).join(docs, "document", "left").withColumn("doc_id", F.coalesce("doc_id", F.lit("?")))
    per_answer = known.groupBy("doc_id", "response_id").agg(F.count(F.lit(1)).alias("n"))
    return per_answer.groupBy("doc_id").agg(F.sum("n").alias("n_citations"), F.count(F.lit(1)).alias("n_answers"))


@query("""SELECT response_id, coalesce(m.title, a.source_doc_id) AS title FROM askresponse a LEFT JOIN manifest m ON a.source_doc_id = m.doc_id WHERE a.source_doc_id IS NOT NULL""")
def citation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = table(spark, sf_dir, "askresponse", "response_id", "source_doc_id").where("source_doc_id IS NOT NULL")
    return titled(scoped, table(spark, sf_dir, "manifest", "doc_id", "title"), "source_doc_id").select("response_id", "title")


@query(rf"""SELECT eval_id, length(regexp_replace(question, '^{_WS}+|{_WS}+$', '', 'g')) BETWEEN 3 AND 1000 AS ok FROM dataset""")
def question_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(stripped(F.col("question")))
    return table(spark, sf_dir, "dataset", "eval_id", "question").select("eval_id", n.between(3, 1000).alias("ok"))


_FOUND = rf"""WITH h AS (SELECT DISTINCT cand_id FROM verify_eval_tokens v JOIN ingest i ON i.source_doc_id = v.source_doc_id AND i.page = v.source_page
        WHERE length(regexp_replace(key_value_token, '{_WS}+', '', 'g')) > 0
        AND contains(lower(regexp_replace(i.text, '{_WS}+', '', 'g')), lower(regexp_replace(key_value_token, '{_WS}+', '', 'g')))),
    found AS (SELECT v.cand_id, h.cand_id IS NOT NULL AS found FROM verify_eval_tokens v LEFT JOIN h USING (cand_id))
"""


@query(_FOUND + "SELECT * FROM found")
def verify_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "verify_eval_tokens", "cand_id", "source_doc_id", "source_page", "key_value_token")
    pages = table(spark, sf_dir, "ingest", "source_doc_id", "page", "text")
    return tokens_found(tokens, pages, "cand_id", "source_doc_id", "source_page", "key_value_token")


@query(_FOUND + "SELECT count(*) FILTER (found) AS n_verified, count(*) FILTER (NOT found) AS n_failed FROM found")
def verify_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_tokens(spark, sf_dir).agg(F.count_if("found").alias("n_verified"), F.count_if(~F.col("found")).alias("n_failed"))


@query("SELECT response_id, nullif(source_doc_id, '') AS source_doc_id, nullif(routing_reason, '') AS routing_reason FROM askresponse")
def empty_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "askresponse", "response_id", "source_doc_id", "routing_reason")
    return rows.select("response_id", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("source_doc_id", "routing_reason")])


@query("""WITH c AS (SELECT eval_id, i, source_doc_id[i] AS doc, source_page[i] AS page, source_page_label[i] AS label FROM dataset, unnest(range(1, least(len(source_doc_id), len(source_page)) + 1)) AS t(i))
    SELECT c.eval_id, i - 1 AS pos, doc, c.page AS page, label, p.source_doc_id IS NOT NULL AS held FROM c LEFT JOIN (SELECT DISTINCT source_doc_id, page FROM ingest) p ON p.source_doc_id = c.doc AND p.page = c.page""")
def scalar_or_list_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list fields of a question zipped up to the shorter one, with whether the page was ingested."""
    rows = table(spark, sf_dir, "dataset", "eval_id", "source_doc_id", "source_page", "source_page_label")
    n = F.least(F.size("source_doc_id"), F.size("source_page"))
    zipped = F.slice(F.arrays_zip("source_doc_id", "source_page", F.coalesce("source_page_label", F.array().cast("array<string>")).alias("source_page_label")), F.lit(1), n)
    flat = rows.select("eval_id", F.posexplode(zipped).alias("pos", "c")).select(
        "eval_id", F.col("pos").cast("long").alias("pos"), F.col("c")["source_doc_id"].alias("doc"), F.col("c")["source_page"].alias("page"), F.col("c")["source_page_label"].alias("label")
    )
    held = table(spark, sf_dir, "ingest", "source_doc_id", "page").distinct().withColumnRenamed("source_doc_id", "doc").withColumn("held", F.lit(True))
    return flat.join(held, ["doc", "page"], "left").select("eval_id", "pos", "doc", "page", "label", F.coalesce("held", F.lit(False)).alias("held"))


@query(r"SELECT doc_id, regexp_replace(path, '[^A-Za-z0-9._-]', '_', 'g') AS safe_path FROM manifest")
def filename_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifest", "doc_id", "path").select("doc_id", safe_filename(F.col("path")).alias("safe_path"))


@query(f"""WITH asked AS (SELECT eval_id, question FROM dataset),
    given AS (SELECT eval_id, count(*) AS n_answers, count(DISTINCT answer) AS n_different, max(response_id) AS last_id, count(*) FILTER ({_REFUSED}) AS n_refused FROM askresponse WHERE eval_id IS NOT NULL GROUP BY 1)
    SELECT asked.eval_id, coalesce(n_answers, 0) AS n_answers, coalesce(n_different, 0) AS n_different, last_id, coalesce(n_refused, 0) AS n_refused FROM asked LEFT JOIN given USING (eval_id)""")
def pipeline_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with what was answered to it; questions without an answer stay.

    Some questions are asked far more often than others: equal answers are counted first, so a hot question is
    reduced before it meets its group.
    """
    rows = table(spark, sf_dir, "askresponse", "response_id", "eval_id", "answer").where("eval_id IS NOT NULL")
    per_text = rows.groupBy("eval_id", "answer").agg(F.count(F.lit(1)).alias("n"), F.max("response_id").alias("last_id"))
    per_question = per_text.groupBy("eval_id").agg(
        F.sum("n").alias("n_answers"), F.count("answer").alias("n_different"), F.max("last_id").alias("last_id"), F.sum(F.when(refused(F.col("answer")), F.col("n")).otherwise(0)).alias("n_refused")
    )
    zero = F.lit(0).cast("long")
    joined = table(spark, sf_dir, "dataset", "eval_id").join(per_question, "eval_id", "left")
    return joined.select("eval_id", F.coalesce("n_answers", zero).alias("n_answers"), F.coalesce("n_different", zero).alias("n_different"), "last_id", F.coalesce("n_refused", zero).alias("n_refused"))


_SAID = r"list_filter(string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: regexp_matches(x, '\S'))"
_SPOKEN = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"


@query(f"""WITH c AS (SELECT DISTINCT eval_id, source_doc_id[i] AS doc, source_page[i] AS page FROM dataset, unnest(range(1, least(len(source_doc_id), len(source_page)) + 1)) AS t(i)),
    said AS (SELECT ingest_id, doc, page, i AS pos, parts[i] AS sentence, {_SPOKEN.format('parts[i]')} AS w
             FROM (SELECT ingest_id, source_doc_id AS doc, page, {_SAID} AS parts FROM ingest WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS t(i)),
    asked AS (SELECT eval_id, {_SPOKEN.format('question')} AS q FROM dataset),
    scored AS (SELECT c.eval_id, ingest_id, pos, sentence, len(list_intersect(q, w)) AS n FROM c JOIN said USING (doc, page) JOIN asked ON asked.eval_id = c.eval_id),
    best AS (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY n DESC, ingest_id, pos) AS nth FROM scored)
    SELECT d.eval_id, CASE WHEN n > 0 THEN sentence END AS sentence, coalesce(n, 0) AS overlap FROM dataset d LEFT JOIN best ON best.eval_id = d.eval_id AND nth = 1""")
def answer_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sentence for each question from the rows of its cited pages."""
    questions = table(spark, sf_dir, "dataset", "eval_id", "question", "source_doc_id", "source_page")
    cited = questions.select("eval_id", F.explode(F.arrays_zip("source_doc_id", "source_page")).alias("c")).select("eval_id", F.col("c.source_doc_id").alias("source_doc_id"), F.col("c.source_page").alias("page"))
    pages = table(spark, sf_dir, "ingest", "source_doc_id", "page", "ingest_id", "text").where("text IS NOT NULL")
    near = pages.join(cited, ["source_doc_id", "page"]).withColumnRenamed("ingest_id", "rank")
    return extracted(questions, near, "eval_id", "question", "text")


@query(_CITED + """, listed AS (SELECT response_id, string_agg('{"document":' || CAST(to_json(document) AS VARCHAR) || ',"page":' || page || '}', ',' ORDER BY place) AS c FROM cited GROUP BY 1)
    SELECT a.response_id, '{"answer":' || CAST(to_json(coalesce(answer, '')) AS VARCHAR) || ',"citations":[' || coalesce(c, '') || ']' || CASE WHEN route IS NULL THEN '' ELSE ',"route":' || CAST(to_json(route) AS VARCHAR) END
        || CASE WHEN nullif(source_doc_id, '') IS NULL THEN '' ELSE ',"source_doc_id":' || CAST(to_json(source_doc_id) AS VARCHAR) END || '}' AS response FROM askresponse a LEFT JOIN listed USING (response_id)""")
def ask_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer as the JSON of a response: its text, its citations once each and in order, its route."""
    rows = table(spark, sf_dir, "askresponse", "response_id", "answer", "route", "source_doc_id")
    cited = _cited(spark, sf_dir).groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("place", "document", "page"))).alias("c"))  # an answer's few citations
    listed = F.transform(F.coalesce("c", F.array().cast("array<struct<place:bigint,document:string,page:int>>")), lambda x: F.struct(x["document"].alias("document"), x["page"].alias("page")))
    body = F.to_json(F.struct(F.coalesce("answer", F.lit("")).alias("answer"), listed.alias("citations"), "route", F.nullif(F.col("source_doc_id"), F.lit("")).alias("source_doc_id")))
    return rows.join(cited, "response_id", "left").select("response_id", body.alias("response"))


@query()
def eval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation loop in one plan: every question is embedded and searched, a sentence of its contexts answers it,
    and the answer and the contexts are scored against its reference and its cited documents.

    ``eval_id, n_contexts, n_hits, answer, n_shared, n_reference``: contexts and those of a cited document; the answer
    with the distinct words it shares with the reference, of so many.
    """
    from ..operators.embedding import embedded
    from ..operators.retrieval import dense_topk

    asked = table(spark, sf_dir, "dataset", "eval_id", "question", "reference", "source_doc_id").where("eval_id IS NOT NULL")
    pages = table(spark, sf_dir, "ingest", "ingest_id", "source_doc_id", "text").where("text IS NOT NULL")
    # a question that recurs is searched and answered once, under its smallest id
    once = asked.groupBy("question").agg(F.min("eval_id").alias("first_id"))
    ranked = dense_topk(
        embedded(once, "question", "embedding", 64), embedded(pages.select("ingest_id", "text"), "text", "embedding", 64), 10, "first_id", "ingest_id"
    )
    # words of the questions join before the texts, so that texts move once
    contexts = ranked.join(once.select("first_id", F.array_distinct(words(F.col("question"))).alias("asked")), "first_id").join(pages, "ingest_id")
    offered = contexts.select("first_id", F.col("source_doc_id").alias("doc"), best_sentence(F.col("asked"), F.col("text"), F.col("rank")).alias("best"))
    found = offered.groupBy("first_id").agg(F.count(F.lit(1)).alias("n_contexts"), F.collect_list("doc").alias("docs"), F.max("best").alias("best"))  # ten a question
    own, said = F.array_distinct(words(F.coalesce("reference", F.lit("")))), words(F.coalesce("answer", F.lit("")))
    answered = once.join(found, "first_id", "left").select(F.col("question").alias("_question"), "n_contexts", "docs", F.when(F.col("best.n") > 0, F.col("best.s")).alias("answer"))
    hits = F.size(F.filter(F.coalesce("docs", F.array().cast("array<string>")), lambda d: F.array_contains("source_doc_id", d)))
    return asked.join(answered, F.col("question").eqNullSafe(F.col("_question"))).select(
        "eval_id", F.coalesce("n_contexts", F.lit(0).cast("long")).alias("n_contexts"), hits.cast("long").alias("n_hits"), "answer",
        F.size(F.array_intersect(own, said)).cast("long").alias("n_shared"), F.size(own).cast("long").alias("n_reference"),
    )


@query()
def verify_tokens_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``verify_tokens``, with tokens and pages in compatibility form and without soft hyphens."""
    from ..functions.unicode import nfkc

    tokens = table(spark, sf_dir, "verify_eval_tokens", "cand_id", "source_doc_id", "source_page", "key_value_token")
    pages = table(spark, sf_dir, "ingest", "source_doc_id", "page", "text")
    return tokens_found(tokens, pages, "cand_id", "source_doc_id", "source_page", "key_value_token", normal=nfkc)
