"""The manifest, page dumps, timestamps and JSON, and a hashing embedder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LINK, hash_tokens, link_kind
from ..sources.tables import table
from .registry import query


@query("SELECT doc_id, title, filename, path, publisher, tier, license, source_url, ingest, notes FROM manifest")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifest", "doc_id", "title", "filename", "path", "publisher", "tier", "license", "source_url", "ingest", "notes")


@query("SELECT doc_id, title, tier FROM manifest WHERE ingest IS TRUE")
def manifest_ingest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifest", "doc_id", "title", "tier", "ingest").where(F.col("ingest").eqNullSafe(True)).drop("ingest")


@query("""SELECT i.source_doc_id, count(*) AS n_rows FROM ingest i WHERE i.source_doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM manifest m WHERE m.doc_id = i.source_doc_id) GROUP BY 1""")
def manifest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that were ingested but that the manifest lacks."""
    counted = table(spark, sf_dir, "ingest", "source_doc_id").where("source_doc_id IS NOT NULL").groupBy("source_doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    docs = table(spark, sf_dir, "manifest", "doc_id").withColumnRenamed("doc_id", "source_doc_id")
    return counted.join(docs, "source_doc_id", "left_anti")


@query("SELECT '  ' || doc_id || ': ' || title AS line FROM manifest WHERE ingest IS TRUE")
def doc_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "manifest", "doc_id", "title", "ingest").where(F.col("ingest").eqNullSafe(True))
    return rows.select(F.format_string("  %s: %s", "doc_id", "title").alias("line"))


@query("SELECT doc_id, coalesce(nullif(title, ''), nullif(source, ''), '?') AS name FROM documents")
def first_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field that is neither null nor empty."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return table(spark, sf_dir, "documents", "doc_id", "title", "source").select("doc_id", F.coalesce(blank("title"), blank("source"), F.lit("?")).alias("name"))


@query("""SELECT source_doc_id, page, count(*) AS n_chunks, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars FROM ingest
    WHERE source_doc_id IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2""")
def pages_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ingest", "source_doc_id", "page", "text").where("source_doc_id IS NOT NULL AND page IS NOT NULL")
    return rows.groupBy("source_doc_id", "page").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("n_chars"))


def _dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_doc_id, page, dump``: the rows of a page under its marker line, in chunk order."""
    rows = table(spark, sf_dir, "ingest", "source_doc_id", "page", "chunk_index", "ingest_id", "text").where("source_doc_id IS NOT NULL AND page IS NOT NULL")
    last = rows.groupBy("source_doc_id").agg(F.max("page").alias("n"))
    pages = rows.groupBy("source_doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "ingest_id", F.coalesce("text", F.lit("")).alias("text")))).alias("c"))
    body = F.array_join(F.transform("c", lambda x: x["text"]), "\n")
    return pages.join(last, "source_doc_id").select("source_doc_id", "page", F.concat(F.format_string("===== %s PAGE %d/%d =====\n", "source_doc_id", "page", "n"), body).alias("dump"))


_DUMPS = r"""WITH last AS (SELECT source_doc_id, max(page) AS n FROM ingest WHERE source_doc_id IS NOT NULL AND page IS NOT NULL GROUP BY 1),
    bodies AS (SELECT source_doc_id, page, string_agg(coalesce(text, ''), chr(10) ORDER BY chunk_index, ingest_id) AS body FROM ingest WHERE source_doc_id IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2),
    dumps AS (SELECT source_doc_id, page, '===== ' || source_doc_id || ' PAGE ' || CAST(page AS BIGINT) || '/' || CAST(n AS BIGINT) || ' =====' || chr(10) || body AS dump FROM bodies JOIN last USING (source_doc_id))
"""


@query(_DUMPS + "SELECT source_doc_id, page, md5(dump) AS digest FROM dumps")
def page_dump_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dumps(spark, sf_dir).select("source_doc_id", "page", F.md5("dump").alias("digest"))


@query(_DUMPS + r"""SELECT source_doc_id AS doc_id, page, md5(body) AS digest FROM bodies""")
def page_dump_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dumps parsed back into documents, pages and texts."""
    head = r"^===== (.+) PAGE (\d+)/(\d+) =====\n"
    return _dumps(spark, sf_dir).select(
        F.regexp_extract("dump", head, 1).alias("doc_id"), F.regexp_extract("dump", head, 2).cast("int").alias("page"), F.md5(F.regexp_replace("dump", head, "")).alias("digest")
    )


@query("""SELECT eval_id, trim(question) AS question, type, coalesce(category, '?') AS category, len(source_doc_id) AS n_docs FROM dataset""")
def eval_dataset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "dataset", "eval_id", "question", "type", "category", "source_doc_id")
    return rows.select("eval_id", F.trim("question").alias("question"), "type", F.coalesce("category", F.lit("?")).alias("category"), F.size("source_doc_id").cast("long").alias("n_docs"))


@query("""SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS label, date_trunc('second', ts) AS parsed FROM events""")
def run_timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps written as run labels and read back."""
    label = F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")
    return table(spark, sf_dir, "events", "event_id", "ts").select("event_id", label.alias("label"), F.to_timestamp_ntz(label, F.lit("yyyyMMdd'T'HHmmss'Z'")).alias("parsed"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("""SELECT doc_id, CASE WHEN source_url IS NULL THEN NULL WHEN starts_with(source_url, '#') THEN 'fragment' WHEN regexp_matches(source_url, '^[a-z][a-z0-9+.-]*:') THEN 'scheme' ELSE 'relative' END AS kind,
    CASE WHEN starts_with(path, '#') THEN 'fragment' WHEN regexp_matches(path, '^[a-z][a-z0-9+.-]*:') THEN 'scheme' ELSE 'relative' END AS path_kind FROM manifest""")
def link_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "manifest", "doc_id", "source_url", "path")
    return rows.select("doc_id", link_kind(F.col("source_url")).alias("kind"), link_kind(F.col("path")).alias("path_kind"))


@query()
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each document's lines outside code fences, rendered from the manifest as markdown."""
    from ..operators.lint import links

    line = F.concat(F.lit("See ["), F.col("title"), F.lit("]("), F.coalesce("source_url", F.col("path")), F.lit(")\n```\n[not](a-link)\n```\n["), F.col("filename"), F.lit("]("), F.regexp_replace("path", " ", "%20"), F.lit(")"))
    pages = table(spark, sf_dir, "manifest", "doc_id", "title", "source_url", "path", "filename").select(F.col("doc_id").alias("file"), line.alias("text"))
    return links(pages, "file", "text", LINK)


_LINKED = """WITH found AS (SELECT 'notes/' || doc_id || '.md' AS file, CASE WHEN ingest IS TRUE THEN '../' || path || '#top' ELSE '../gone/' || filename END AS target FROM manifest)
"""


@query(_LINKED + "SELECT file, target FROM found WHERE replace(split_part(target, '#', 1), '../', '') NOT IN (SELECT path FROM manifest)")
def dead_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on each document link to its file, seen from their own folder; those of documents that were not ingested lead nowhere."""
    from ..operators.lint import dead_links as dead

    docs = table(spark, sf_dir, "manifest", "doc_id", "path", "filename", "ingest")
    target = F.when(F.col("ingest").eqNullSafe(True), F.concat(F.lit("../"), "path", F.lit("#top"))).otherwise(F.concat(F.lit("../gone/"), "filename"))
    return dead(docs.select(F.concat(F.lit("notes/"), "doc_id", F.lit(".md")).alias("file"), target.alias("target")), docs, "path")


@query("SELECT ingest_id, unnest(list_distinct([substr(md5(text), 1, 12), md5(lower(text))])) AS hash FROM ingest WHERE text IS NOT NULL")
def hash_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit-like tokens of texts that cite their own digests."""
    rows = table(spark, sf_dir, "ingest", "ingest_id", "text").where("text IS NOT NULL")
    cited = F.concat(F.lit("see "), F.substring(F.md5("text"), 1, 12), F.lit(", "), F.md5(F.lower("text")))
    return rows.select("ingest_id", F.explode(hash_tokens(cited)).alias("hash"))


@query("""WITH w AS (SELECT ingest_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM ingest WHERE text IS NOT NULL),
    h AS (SELECT ingest_id, CAST('0x' || substr(md5(word), 1, 6) AS BIGINT) % 64 AS bucket, CASE WHEN CAST('0x' || substr(md5(word), 7, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM w)
    SELECT ingest_id, bucket, CAST(sum(s) AS BIGINT) AS weight FROM h GROUP BY 1, 2 HAVING sum(s) <> 0""")
def embed_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature hashing of words into 64 signed buckets, as sparse rows."""
    from ..operators.embedding import hashed_features

    return hashed_features(table(spark, sf_dir, "ingest", "ingest_id", "text"), "ingest_id", "text", 64)
