"""Readers of the given tables. Each selects the columns it is asked for, so the scan reads no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest_chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per chunk id and namespace: of rows ingested again the last stands.

    The largest id wins, as ingest ids rise and never repeat. Only ids are aggregated, in a hash table and partly before
    the shuffle; the texts of the winners then move once.
    """
    rows = table(spark, sf_dir, "ingest")
    wanted = list(columns or rows.columns)
    last = table(spark, sf_dir, "ingest", "namespace", "id", "ingest_id").groupBy("namespace", "id").agg(F.max("ingest_id").alias("ingest_id"))
    if set(wanted) <= {"namespace", "id", "ingest_id"}:
        return last.select(*wanted)
    picked = rows.select(*{*wanted, "ingest_id"}).join(last.select("ingest_id"), "ingest_id", "left_semi")
    return picked.select(*wanted)


def read_manifest_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a manifest file ``{"docs": [...]}``, one row each."""
    schema = "docs ARRAY<STRUCT<doc_id STRING, title STRING, filename STRING, path STRING, publisher STRING, tier INT, license STRING, source_url STRING, ingest BOOLEAN, notes STRING>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("docs"))


def read_eval_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions, one JSON object a line; fields that hold one value or a list come out as lists."""
    schema = "question STRING, reference STRING, source_doc_id STRING, source_page STRING, source_page_label STRING, type STRING, category STRING, confidence STRING"
    rows = spark.read.schema(schema).json(path)
    listed = lambda c, kind: F.coalesce(F.from_json(c, f"array<{kind}>"), F.when(F.col(c).isNotNull(), F.array(F.col(c).cast(kind))))
    return rows.withColumns({
        "source_doc_id": listed("source_doc_id", "string"), "source_page": listed("source_page", "int"), "source_page_label": listed("source_page_label", "string"),
    })


def read_page_dumps(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, page, text`` from text files that mark pages by ``===== doc PAGE n/N =====`` lines."""
    files = spark.read.text(path, wholetext=True)
    marked = files.select(F.explode(F.split("value", r"(?=(?m)^===== )")).alias("part")).where(F.col("part").startswith("===== "))
    head = r"^===== (.+) PAGE (\d+)/(\d+) =====\n?"
    return marked.select(
        F.regexp_extract("part", head, 1).alias("doc_id"), F.regexp_extract("part", head, 2).cast("int").alias("page"), F.regexp_replace("part", head, "").alias("text")
    )


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``file, text`` of markdown files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def newest_file(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``file`` of the newest file under ``path``, by modification time, then name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("file"))


def missing_paths(manifest: DataFrame, folder: str) -> DataFrame:
    """Rows of the manifest whose file does not lie under ``folder``; only names are listed, no contents read."""
    listed = manifest.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"))
    return manifest.join(listed.distinct(), "filename", "left_anti")
