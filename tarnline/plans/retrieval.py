"""Search over the embeddings table: questions are the rows whose id is divisible by 20, vectors all others' too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import context_block as block_of
from ..functions.text import context_string
from ..functions.vector import cosine
from ..operators.retrieval import average_precision, dense_topk as search, first_places, ordered_contexts, scoped_with_fallback
from ..sources.tables import table
from .registry import query

K = 10


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("doc"))
    return rows.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id"), rows


def _ranked(spark: SparkSession, sf_dir: str, k: int = K, scope: str | None = None) -> DataFrame:
    questions, vectors = _sides(spark, sf_dir)
    return search(questions, vectors, k, scope=scope)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id", "label").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("doc"))


_SCORED = """
    WITH pairs AS (
        SELECT q.vec_id AS query_id, v.vec_id AS id, q.label AS q_label, v.label AS v_label,
               round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) AS s
        FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM pairs),
    scoped AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM pairs WHERE q_label = v_label)
"""


@query(_SCORED + "SELECT query_id, rank, id, round(s, 6) AS score FROM ranked WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(_SCORED + "SELECT query_id, rank, id, round(s, 6) AS score FROM scoped WHERE rank <= 10")
def dense_topk_source_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, scope="doc").withColumn("score", F.round("score", 6))


@query(_SCORED + "SELECT query_id, rank, id, 'vec ' || id AS text, CAST(v_label AS VARCHAR) AS source_doc_id FROM ranked WHERE rank <= 10")
def retrieved_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late materialisation: text and document join the few ranked rows, not the ranking."""
    ranked = _ranked(spark, sf_dir).join(_labels(spark, sf_dir), "id")
    return ranked.select("query_id", "rank", "id", F.concat(F.lit("vec "), F.col("id")).alias("text"), F.col("doc").alias("source_doc_id"))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = retrieved_projection(spark, sf_dir)
    return ordered_contexts(ranked, "query_id", context_string(F.col("source_doc_id"), F.col("id"), F.col("text")))


_CONTEXTS = _SCORED + """, contexts AS (
    SELECT query_id, list('[source_doc_id=' || v_label || ' page=' || id || ']' || chr(10) || 'vec ' || id ORDER BY rank) AS contexts
    FROM ranked WHERE rank <= 10 GROUP BY query_id)
"""


@query(_CONTEXTS + "SELECT query_id, contexts FROM contexts")
def format_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir)


@query(_CONTEXTS + "SELECT query_id, array_to_string(contexts, chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS block FROM contexts")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir).select("query_id", block_of(F.col("contexts")).alias("block"))


@query(_SCORED + """, five AS (SELECT query_id, id FROM ranked WHERE rank <= 5), ten AS (SELECT query_id, id FROM ranked WHERE rank <= 10)
    SELECT f.query_id, count(*) AS n_five, count(t.id) AS n_kept FROM five f LEFT JOIN ten t USING (query_id, id) GROUP BY 1""")
def depth_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the first five stay when the depth is doubled: all of them."""
    five, ten = _ranked(spark, sf_dir, 5), _ranked(spark, sf_dir, 10).select("query_id", "id", F.lit(1).alias("kept"))
    return five.join(ten, ["query_id", "id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_five"), F.count("kept").alias("n_kept"))


@query(_SCORED + """SELECT query_id, min(CASE WHEN q_label = v_label AND query_id <> id THEN rank END) AS best_rank
    FROM ranked WHERE rank <= 100 GROUP BY 1""")
def rank_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rank, within a hundred, of another vector of the question's own document."""
    ranked = _ranked(spark, sf_dir, 100)
    docs = _labels(spark, sf_dir)
    own = docs.withColumnsRenamed({"id": "query_id", "doc": "own"})
    hit = (F.col("doc") == F.col("own")) & (F.col("id") != F.col("query_id"))
    return ranked.join(docs, "id").join(own, "query_id").groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("best_rank"))


@query(_SCORED + """, without AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM pairs WHERE v_label <> 3)
    SELECT query_id, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_same, count(*) FILTER (b IS NULL) AS n_lost, count(*) FILTER (a IS NULL) AS n_new
    FROM (SELECT coalesce(x.query_id, y.query_id) AS query_id, x.id AS a, y.id AS b
          FROM (SELECT query_id, id FROM ranked WHERE rank <= 10) x FULL JOIN (SELECT query_id, id FROM without WHERE r <= 10) y USING (query_id, id)) GROUP BY 1""")
def retrieval_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each ranking stays, goes and comes when one document leaves the index."""
    questions, vectors = _sides(spark, sf_dir)
    before = search(questions, vectors, K).select("query_id", "id", F.lit(True).alias("was"))
    after = search(questions, vectors.where("doc <> '3'"), K).select("query_id", "id", F.lit(True).alias("now"))
    both = before.join(after, ["query_id", "id"], "full")
    return both.groupBy("query_id").agg(
        F.count_if(F.col("was") & F.col("now")).alias("n_same"), F.count_if(F.col("now").isNull()).alias("n_lost"), F.count_if(F.col("was").isNull()).alias("n_new")
    )


@query("""SELECT a.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with its successor."""
    a = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("cos"))


@query(_SCORED + """, held AS (SELECT vec_id, label FROM embeddings WHERE label NOT IN (1, 4)),
    p AS (SELECT pairs.* FROM pairs WHERE v_label NOT IN (1, 4)),
    inside AS (SELECT query_id, id, 'source_scoped' AS route, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM p WHERE q_label = v_label),
    open AS (SELECT query_id, id, 'direct' AS route, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM p
             WHERE query_id NOT IN (SELECT query_id FROM inside))
    SELECT * FROM inside WHERE rank <= 10 UNION ALL SELECT * FROM open WHERE rank <= 10""")
def scoped_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoped search over an index that lacks two documents; questions about those fall back to the open search."""
    questions, vectors = _sides(spark, sf_dir)
    found = scoped_with_fallback(questions, vectors.where("doc NOT IN ('1', '4')"), K, "doc")
    return found.select("query_id", "id", "route", "rank")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _labels(spark, sf_dir)
    own = docs.withColumnsRenamed({"id": "query_id", "doc": "own"})
    return _ranked(spark, sf_dir).join(docs, "id").join(own, "query_id").select("query_id", "rank", "id", "score", (F.col("doc") == F.col("own")).alias("hit"))


_VERDICTS = _SCORED + """, v AS (SELECT query_id, rank, id, s, q_label, q_label = v_label AS hit FROM ranked WHERE rank <= 10),
    relevant AS (SELECT q.vec_id AS query_id, count(*) AS n FROM embeddings q JOIN embeddings x ON q.label = x.label WHERE q.vec_id % 20 = 0 GROUP BY 1)
"""


@query(_VERDICTS + """SELECT query_id, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(coalesce(avg(CASE WHEN hit THEN p END), 0), 6) AS average_precision
    FROM (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) / rank AS p FROM v) GROUP BY 1""")
def context_precision_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return average_precision(_verdicts(spark, sf_dir), "query_id").withColumn("average_precision", F.round("average_precision", 6))


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each question's own document, from counts per document."""
    docs = _labels(spark, sf_dir)
    per_doc = docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    return docs.where(F.col("id") % 20 == 0).join(per_doc, "doc").select(F.col("id").alias("query_id"), "n")


@query(_VERDICTS + "SELECT query_id, round(count(*) FILTER (hit) / any_value(n), 6) AS recall FROM v JOIN relevant USING (query_id) GROUP BY 1")
def context_recall_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _verdicts(spark, sf_dir).groupBy("query_id").agg(F.count_if("hit").alias("hits"))
    return hits.join(_relevant(spark, sf_dir), "query_id").select("query_id", F.round(F.col("hits") / F.col("n"), 6).alias("recall"))


@query(_VERDICTS + "SELECT query_id, round(count(*) FILTER (hit) / count(*), 6) AS ratio FROM v GROUP BY 1")
def faithfulness_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supported statements of all, with the retrieved rows standing for statements."""
    return _verdicts(spark, sf_dir).groupBy("query_id").agg(F.round(F.count_if("hit") / F.count(F.lit(1)), 6).alias("ratio"))


@query(_VERDICTS + "SELECT query_id, round(avg(s), 6) AS relevancy FROM v WHERE rank <= 3 GROUP BY 1")
def answer_relevancy_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).where("rank <= 3").groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("relevancy"))


@query(_VERDICTS + """SELECT query_id, round(0.75 * h / (h + 0.5 * ((k - h) + (n - h))) + 0.25 * top, 6) AS correctness
    FROM (SELECT query_id, count(*) FILTER (hit) AS h, count(*) AS k, any_value(n) AS n, max(CASE WHEN rank = 1 THEN s END) AS top FROM v JOIN relevant USING (query_id) GROUP BY 1)""")
def answer_correctness_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the F1 of hits, misses and unretrieved relevant rows, one quarter of the best similarity."""
    seen = _verdicts(spark, sf_dir).groupBy("query_id").agg(F.count_if("hit").alias("h"), F.count(F.lit(1)).alias("k"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"))
    f1 = F.col("h") / (F.col("h") + 0.5 * ((F.col("k") - F.col("h")) + (F.col("n") - F.col("h"))))
    return seen.join(_relevant(spark, sf_dir), "query_id").select("query_id", F.round(0.75 * f1 + 0.25 * F.col("top"), 6).alias("correctness"))


@query("""WITH d AS (SELECT label, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], lead(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[]) AS d FROM embeddings)
    SELECT label, vec_id, round(d, 6) AS distance FROM d WHERE d IS NOT NULL""")
def consecutive_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.runs import following

    rows = following(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "label", ["vec_id"], "embedding", "next")
    return rows.where(F.col("next").isNotNull()).select("label", "vec_id", F.round(F.lit(1.0) - cosine(F.col("embedding"), F.col("next")), 6).alias("distance"))


@query("""WITH d AS (SELECT label, vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], lead(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[]), 15) AS d FROM embeddings),
    t AS (SELECT label, round(quantile_cont(d, 0.95), 9) AS t FROM d GROUP BY 1),
    c AS (SELECT d.label, vec_id, coalesce(lag(round(d, 9) > t) OVER (PARTITION BY d.label ORDER BY vec_id), false) AS cut FROM d JOIN t ON d.label = t.label),
    g AS (SELECT label, vec_id, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS chunk_no FROM c)
    SELECT label, CAST(chunk_no AS BIGINT) AS chunk_no, count(*) AS n, min(vec_id) AS first_id FROM g GROUP BY 1, 2""")
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each label's vectors in id order, cut where neighbours are farther apart than its 95th percentile."""
    from ..operators.chunking import semantic_groups

    groups = semantic_groups(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "label", "vec_id", "embedding")
    return groups.groupBy("label", "chunk_no").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))


@query(_SCORED + """, docs AS (SELECT query_id, v_label, min(rank) AS rank FROM ranked WHERE rank <= 10 GROUP BY 1, 2)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, CAST(v_label AS VARCHAR) AS doc FROM docs""")
def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each ranking in the order in which they first appear."""
    kept = first_places(_ranked(spark, sf_dir).join(_labels(spark, sf_dir), "id"), ["query_id", "doc"], ["rank"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    return kept.select("query_id", place.alias("place"), "doc")
