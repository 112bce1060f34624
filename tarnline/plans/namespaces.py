"""The ingest table as a store of namespaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, page_of_id
from ..operators.namespaces import copied, duplicates, edge_and_middle, mismatches, upserted
from ..sources.tables import latest_chunks, table
from .registry import query

#: Sources whose chunks are made anew in a rebuild; all others are copied.
TARGETS = ("pellam-pocket-guide", "sds-quillon-velmidine")

_LATEST = """
    WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, id ORDER BY ingest_id DESC) AS rn FROM ingest) WHERE rn = 1)
"""


@query("SELECT namespace, count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(DISTINCT source_doc_id) AS n_docs FROM ingest GROUP BY 1")
def namespace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ingest", "namespace", "id", "source_doc_id")
    per_id = rows.groupBy("namespace", "id", "source_doc_id").agg(F.count(F.lit(1)).alias("n"))
    per_namespace = per_id.groupBy("namespace").agg(F.sum("n").alias("n_rows"))
    ids = per_id.select("namespace", "id").distinct().groupBy("namespace").agg(F.count("id").alias("n_ids"))
    docs = per_id.select("namespace", "source_doc_id").distinct().groupBy("namespace").agg(F.count("source_doc_id").alias("n_docs"))
    return per_namespace.join(ids, "namespace").join(docs, "namespace")


@query(_LATEST + "SELECT namespace, id, ingest_id, md5(text) AS digest FROM latest")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under even ids and those under odd ones, merged: of each key the one ingested last."""
    rows = table(spark, sf_dir, "ingest", "namespace", "id", "ingest_id", "text")
    half = F.col("ingest_id") % 2 == 0
    merged = upserted(rows.where(half), rows.where(~half), ["namespace", "id"], "ingest_id")
    return merged.select("namespace", "id", "ingest_id", F.md5("text").alias("digest"))


@query("SELECT namespace, id, count(*) AS n FROM ingest GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "ingest", "namespace", "id"), ["namespace", "id"])


@query(_LATEST + """SELECT 'semantic_v3' AS namespace, id, ingest_id FROM latest
    WHERE namespace = 'semantic_v2' AND coalesce(source_doc_id, '') NOT IN ('pellam-pocket-guide', 'sds-quillon-velmidine')""")
def namespace_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_chunks(spark, sf_dir, "namespace", "id", "ingest_id", "source_doc_id")
    return copied(rows, "semantic_v2", "semantic_v3", F.col("source_doc_id").isin(*TARGETS)).select("namespace", "id", "ingest_id")


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copied chunks of all but the targets, and the targets' lines as chunks of their own."""
    rows = latest_chunks(spark, sf_dir, "namespace", "id", "ingest_id", "source_doc_id", "page", "chunk_index", "text")
    target = F.col("source_doc_id").isin(*TARGETS)
    kept = copied(rows, "semantic_v2", "semantic_v3", target).select("namespace", "id", "source_doc_id", "text")
    lines = rows.where((F.col("namespace") == "semantic_v2") & target & F.col("text").isNotNull()).select(
        "id", "source_doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")
    )
    made = lines.where(F.col("line").rlike(r"\S")).select(
        F.lit("semantic_v3").alias("namespace"), F.concat_ws("-", "id", F.col("n")).alias("id"), "source_doc_id", F.col("line").alias("text")
    )
    return kept.unionByName(made)


_REBUILT = _LATEST + """, kept AS (SELECT id, source_doc_id, text FROM latest WHERE namespace = 'semantic_v2' AND coalesce(source_doc_id, '') NOT IN ('pellam-pocket-guide', 'sds-quillon-velmidine')),
    made AS (SELECT id || '-' || (i - 1) AS id, source_doc_id, parts[i] AS text FROM (
        SELECT id, source_doc_id, string_split(text, chr(10)) AS parts FROM latest
        WHERE namespace = 'semantic_v2' AND source_doc_id IN ('pellam-pocket-guide', 'sds-quillon-velmidine') AND text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS t(i)
        WHERE regexp_matches(parts[i], '\\S')),
    rebuilt AS (SELECT * FROM kept UNION ALL SELECT * FROM made)
"""


@query(_REBUILT + "SELECT source_doc_id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM rebuilt GROUP BY 1")
def namespace_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebuilt(spark, sf_dir).groupBy("source_doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query(_REBUILT + """SELECT (SELECT count(*) FROM kept) AS n_copied, (SELECT count(*) FROM made) AS n_made, (SELECT count(*) FROM rebuilt) AS n_total,
    (SELECT count(*) FROM kept) + (SELECT count(*) FROM made) = (SELECT count(*) FROM rebuilt) AS ok""")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = _rebuilt(spark, sf_dir)
    made = F.coalesce(F.col("source_doc_id").isin(*TARGETS), F.lit(False))
    counted = rebuilt.agg(F.count_if(~made).alias("n_copied"), F.count_if(made).alias("n_made"), F.count(F.lit(1)).alias("n_total"))
    return counted.withColumn("ok", F.col("n_copied") + F.col("n_made") == F.col("n_total"))


@query(_LATEST + """, old AS (SELECT id, text FROM latest WHERE namespace = 'semantic'), new AS (SELECT id, text FROM latest WHERE namespace = 'semantic_v2')
    SELECT coalesce(old.id, new.id) AS id, CASE WHEN new.id IS NULL THEN 'missing' WHEN old.id IS NULL THEN 'extra' ELSE 'differs' END AS issue
    FROM old FULL JOIN new ON old.id = new.id WHERE old.id IS NULL OR new.id IS NULL OR old.text IS DISTINCT FROM new.text""")
def copy_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of two namespaces compared, not a sample."""
    rows = latest_chunks(spark, sf_dir, "namespace", "id", "text")
    return mismatches(rows.where("namespace = 'semantic'"), rows.where("namespace = 'semantic_v2'"), ["id"], ["text"])


_PAGED = """WITH r AS (SELECT source_doc_id, ingest_id, row_number() OVER (PARTITION BY source_doc_id ORDER BY page, ingest_id) - 1 AS rn, count(*) OVER (PARTITION BY source_doc_id) AS total
    FROM ingest WHERE source_doc_id IS NOT NULL AND page IS NOT NULL)"""


@query(_PAGED + """ SELECT source_doc_id, max(CASE WHEN rn = 0 THEN ingest_id END) AS first_id, max(CASE WHEN rn = total // 2 THEN ingest_id END) AS middle_id,
    max(CASE WHEN rn = total - 1 THEN ingest_id END) AS last_id FROM r GROUP BY 1""")
def copy_sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ingest", "source_doc_id", "page", "ingest_id").where("source_doc_id IS NOT NULL AND page IS NOT NULL")
    return edge_and_middle(rows, "source_doc_id", ["page", "ingest_id"], "ingest_id")


@query("""SELECT namespace, (ingest_id - 1) // 100 AS batch, count(*) AS n, min(ingest_id) AS first_id, max(ingest_id) AS last_id FROM ingest GROUP BY 1, 2""")
def upsert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by ranges of the id, which need no global numbering of rows."""
    rows = table(spark, sf_dir, "ingest", "namespace", "ingest_id")
    return rows.groupBy("namespace", F.floor((F.col("ingest_id") - 1) / 100).alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ingest_id").alias("first_id"), F.max("ingest_id").alias("last_id")
    )


@query(r"""SELECT ingest_id, coalesce(TRY_CAST(nullif(regexp_extract(id, '-p(\d+)-', 1), '') AS BIGINT), -1) AS page_of_id,
    source_doc_id || '-p' || CAST(page AS BIGINT) || '-' || chunk_index = id AS agrees FROM ingest""")
def chunk_id_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ingest", "ingest_id", "id", "source_doc_id", "page", "chunk_index")
    made = F.when(F.col("source_doc_id").isNotNull() & F.col("page").isNotNull() & F.col("chunk_index").isNotNull(), chunk_id(F.col("source_doc_id"), F.col("page"), F.col("chunk_index")))
    return rows.select("ingest_id", page_of_id(F.col("id")).alias("page_of_id"), (made == F.col("id")).alias("agrees"))


@query("""SELECT v.cand_id, count(i.ingest_id) AS n_rows FROM verify_eval_tokens v
    LEFT JOIN ingest i ON i.source_doc_id = v.source_doc_id AND i.page = v.source_page GROUP BY 1""")
def vector_fetch_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each cited page; the pages are counted first, so a page cited often is read once."""
    cited = table(spark, sf_dir, "verify_eval_tokens", "cand_id", "source_doc_id", "source_page").withColumnRenamed("source_page", "page")
    pages = table(spark, sf_dir, "ingest", "source_doc_id", "page").groupBy("source_doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    return cited.join(pages, ["source_doc_id", "page"], "left").select("cand_id", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query("""SELECT m.doc_id, count(i.id) AS n_ids FROM manifest m LEFT JOIN (SELECT DISTINCT id FROM ingest) i ON starts_with(i.id, m.doc_id || '-p') GROUP BY 1""")
def vector_list_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids under each document's prefix; the prefix is cut from the id, so the join is by equality."""
    ids = table(spark, sf_dir, "ingest", "id").distinct()
    named = ids.withColumn("doc_id", F.regexp_extract("id", r"^(.*)-p[^-]*-[^-]*$", 1)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    docs = table(spark, sf_dir, "manifest", "doc_id")
    return docs.join(named, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_ids"))


@query("""WITH d AS (SELECT source_doc_id, count(*) AS n FROM ingest WHERE source_doc_id IS NOT NULL GROUP BY 1)
    SELECT coalesce(m.doc_id, d.source_doc_id) AS doc_id, m.doc_id IS NOT NULL AS listed, coalesce(n, 0) AS n_chunks, coalesce(m.ingest, false) AS wanted
    FROM manifest m FULL JOIN d ON m.doc_id = d.source_doc_id""")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document, with those the manifest lacks and those without chunks."""
    docs = table(spark, sf_dir, "manifest", "doc_id", "ingest").withColumn("listed", F.lit(True))
    counted = table(spark, sf_dir, "ingest", "source_doc_id").where("source_doc_id IS NOT NULL").groupBy(F.col("source_doc_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return docs.join(counted, "doc_id", "full").select(
        "doc_id", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("ingest", F.lit(False)).alias("wanted")
    )


@query("""SELECT source_doc_id, page, chunk_index, ingest_id, row_number() OVER (PARTITION BY source_doc_id, page ORDER BY chunk_index, ingest_id) - 1 AS place
    FROM ingest WHERE source_doc_id IS NOT NULL AND page IS NOT NULL""")
def chunk_index_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("source_doc_id", "page").orderBy("chunk_index", "ingest_id")
    rows = table(spark, sf_dir, "ingest", "source_doc_id", "page", "chunk_index", "ingest_id").where("source_doc_id IS NOT NULL AND page IS NOT NULL")
    return rows.withColumn("place", F.row_number().over(order).cast("long") - 1)


@query("""SELECT i.ingest_id, i.id FROM ingest i WHERE i.id IN (SELECT source_doc_id || '-p' || CAST(source_page AS BIGINT) || '-0' FROM verify_eval_tokens)""")
def vector_fetch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows under the ids of the first chunks of cited pages; ids are distinct before they meet the table."""
    cited = table(spark, sf_dir, "verify_eval_tokens", "source_doc_id", "source_page").where("source_doc_id IS NOT NULL AND source_page IS NOT NULL")
    ids = cited.select(chunk_id(F.col("source_doc_id"), F.col("source_page"), F.lit(0)).alias("id")).distinct()
    return table(spark, sf_dir, "ingest", "ingest_id", "id").join(ids, "id", "left_semi").select("ingest_id", "id")


@query("SELECT namespace, count(*) AS n_chunks, count(*) AS n_vectors, true AS ok FROM ingest WHERE text IS NOT NULL GROUP BY 1")
def vectors_match_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and their vectors: a vector is a column of its chunk's row, so none can be lost or change places."""
    from ..operators.embedding import embedded

    rows = embedded(table(spark, sf_dir, "ingest", "namespace", "text").where("text IS NOT NULL"), "text", "vector", 64)
    counted = rows.groupBy("namespace").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.size("vector") == 64).alias("n_vectors"))
    return counted.withColumn("ok", F.col("n_chunks") == F.col("n_vectors"))


_CONTENT = """WITH k AS (SELECT DISTINCT namespace, source_doc_id, page, sha1(text) AS h FROM ingest WHERE source_doc_id IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL),
    a AS (SELECT * FROM k WHERE namespace = 'semantic'), b AS (SELECT * FROM k WHERE namespace = 'semantic_v2')
"""


@query(_CONTENT + """SELECT coalesce(a.source_doc_id, b.source_doc_id) AS source_doc_id, count(*) FILTER (a.h IS NOT NULL AND b.h IS NOT NULL) AS n_same,
    count(*) FILTER (b.h IS NULL) AS n_lost, count(*) FILTER (a.h IS NULL) AS n_new FROM a FULL JOIN b ON a.source_doc_id = b.source_doc_id AND a.page = b.page AND a.h = b.h GROUP BY 1""")
def content_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the contents, by page and digest, that two namespaces share or that only one holds; one pass."""
    rows = table(spark, sf_dir, "ingest", "namespace", "source_doc_id", "page", "text").where("source_doc_id IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL AND namespace IN ('semantic', 'semantic_v2')")
    sides = rows.groupBy("source_doc_id", "page", F.sha1("text").alias("h")).agg(F.bool_or(F.col("namespace") == "semantic").alias("was"), F.bool_or(F.col("namespace") == "semantic_v2").alias("now"))
    return sides.groupBy("source_doc_id").agg(
        F.count_if(F.col("was") & F.col("now")).alias("n_same"), F.count_if(~F.col("now")).alias("n_lost"), F.count_if(~F.col("was")).alias("n_new")
    )


@query(r"""SELECT count(*) AS n, count(*) FILTER (nullif(trim(key_value_token), '') IS NOT NULL) AS n_tokens, count(DISTINCT source_doc_id || '/' || source_page) AS n_pages FROM verify_eval_tokens""")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "verify_eval_tokens", "key_value_token", "source_doc_id", "source_page")
    kept = rows.withColumn("key", F.concat("source_doc_id", F.lit("/"), F.col("source_page").cast("string")))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif(F.trim("key_value_token"), F.lit(""))).alias("n_tokens"), F.count_distinct("key").alias("n_pages"))
