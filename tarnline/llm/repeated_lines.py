"""Problem 1: lines repeated across one source's documents, by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, key_filter, slices
from .rolling import joined_keys, lines_and_chunks

MIN_ROWS, MIN_SHARE = 5, 0.05
WINDOW, MEAN_CHUNK = 8, 16


def _sources(part: pa.RecordBatch) -> np.ndarray:
    return part.column("source").to_numpy(zero_copy_only=False)


def excessive_chunks(rows: DataFrame, min_share: float) -> DataFrame:
    """``key`` of the (source, chunk) that may stand in at least ``min_share`` of the rows of their source.

    Distinct rows are counted per chunk and source in every batch. A chunk that stands in a share of all rows of its
    source stands in that share of the source's rows of at least one batch, so all others are left out before
    anything is shuffled, whatever rows one source or chunk holds.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, size = np.unique(_sources(batch), return_counts=True)
            owners, chunks = [], []
            for part in slices(batch, "text"):
                found = lines_and_chunks(part.column("text").to_pylist(), WINDOW, MEAN_CHUNK)
                owners.append(np.searchsorted(source, _sources(part)[found["chunk_row"]]))
                chunks.append(found["chunk"])
            if not owners:
                continue
            owner, chunk = np.concatenate(owners), np.concatenate(chunks)
            key, first, n = np.unique(joined_keys(source[owner], chunk), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key[n >= size[owner[first]] * min_share - 1e-9])], names=["key"])

    return rows.select("source", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "key long").distinct()


def candidate_lines(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """``row_id, source, line_no, line_1, line_2, line_first`` of the lines all of whose chunks may be excessive."""
    shared = texts.sparkSession.sparkContext.broadcast(key_filter(chunks))  # bounded by MOST_BITS

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = lines_and_chunks(part.column("text").to_pylist(), WINDOW, MEAN_CHUNK)
                row = found["line_row"]
                if not len(row):
                    continue
                source = np.repeat(_sources(part)[row], found["inner_size"])
                held = shared.value.holds(joined_keys(source, found["inner"]))
                keep = np.flatnonzero(np.logical_and.reduceat(held, found["inner_from"]))
                at = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_id").take(at), part.column("source").take(at)] + [pa.array(found[k][keep]) for k in ("line_no", "line_1", "line_2", "line_first")],
                    names=["row_id", "source", "line_no", "line_1", "line_2", "line_first"],
                )

    kind = texts.schema["row_id"].dataType.simpleString()
    return texts.mapInArrow(lines, f"row_id {kind}, source long, line_no long, line_1 long, line_2 long, line_first long")


def repeated_lines(
    df: DataFrame, id_col: str = "ingest_id", source_col: str = "source_doc_id", text_col: str = "text",
    min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE,
) -> DataFrame:
    """Every place of a line that recurs in too many rows of its source: ``row_id, line_no``.

    Two lines are the same if they are equal once digits and white space are left out and case is ignored. A
    line counts if it stands in at least ``min_rows`` rows and ``min_share`` of all rows of its source.

    Steps: texts are cut into content-defined chunks by a rolling hash that knows no line breaks; rows are counted
    per chunk and source; lines made of excessive chunks are candidates, as every row with the line has its chunks,
    and are left where they lie otherwise; the candidates' own rows are then counted exactly under 128-bit
    fingerprints. A line too short to hold a whole chunk is a chunk of its own.

    Null sources give no rows; null texts count in their source's total; blank lines and lines without a letter
    are never cases; the id may repeat (each row is a row of its own only under its own id). An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = df.select(
        F.col(id_col).alias("row_id"), F.xxhash64(F.col(source_col)).alias("source"), F.col(text_col).alias("text"),
    ).where(F.col(source_col).isNotNull())
    needed = F.greatest(F.lit(float(min_rows)), F.col("total") * F.lit(min_share) - F.lit(1e-9))
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= min_rows)

    chunks = cut_lineage(excessive_chunks(rows, min_share))
    candidates = cut_lineage(candidate_lines(rows.where(F.col("text").isNotNull()), chunks))  # read twice below

    key = ["source", "line_1", "line_2"]
    cases = (
        candidates.groupBy(*key).agg(F.sum("line_first").alias("n")).where(F.col("n") >= min_rows)
        .join(totals, "source").where(F.col("n") >= needed).select(*key)
    )
    return candidates.join(cases, key, "left_semi").select("row_id", "line_no")


def without_lines(df: DataFrame, found: DataFrame, id_col: str = "ingest_id", text_col: str = "text") -> DataFrame:
    """``df`` with the found lines cut from each text and all else unchanged; rows without a case keep their text."""
    cuts = found.groupBy("row_id").agg(F.collect_set("line_no").alias("_cut"))
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("_cut"), (i + 1).cast("long")))
    return (
        df.join(cuts.withColumnRenamed("row_id", "_row"), F.col(id_col) == F.col("_row"), "left")
        .withColumn(text_col, F.when(F.col("_cut").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
        .drop("_cut", "_row")
    )
