"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters handled at once inside a task; keeps the arrays of a slice in the cache.
SLICE_CHARS = 250_000


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, so that the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder of the session and read back.

    The folder is the one in ``spark.checkpoint.dir``; where that is unset (tests on one machine) a
    temporary folder is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Bits of a filter for each key, and at most; with more keys more of what is not wanted passes, and nothing is lost.
BITS_A_KEY, MOST_BITS = 16, 1 << 26


class KeyFilter:
    """A Bloom filter over 64-bit keys in numpy: passes every key it was built from and few others.

    Its size is bounded whatever the number of keys, so it may be broadcast, and rows that cannot meet a key are left
    out where they lie, before any shuffle. An exact join follows wherever it is used.
    """

    def __init__(self, size: int, words: np.ndarray, bits: np.ndarray):
        self.size = size
        self.words = np.zeros(size >> 6, dtype=np.uint64)
        self.words[words] = bits.view(np.uint64)

    @staticmethod
    def places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        mixed = keys.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        mixed = mixed ^ (mixed >> np.uint64(32))
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        last = np.uint64(size - 1)
        return mixed & last, (mixed >> np.uint64(34)) & last

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for place in self.places(keys, self.size):
            out &= ((self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def key_filter(keys: DataFrame) -> KeyFilter:
    """The filter of a table's first column, a long; its bits are set in Spark and at most MOST_BITS reach the driver."""
    (name,) = keys.columns
    size = 1 << max(10, min(MOST_BITS.bit_length() - 1, (keys.count() * BITS_A_KEY).bit_length()))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.concatenate(KeyFilter.places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), size))
            places = np.unique(places)
            if len(places):
                word, first = np.unique(places >> np.uint64(6), return_index=True)
                held = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(held.view(np.int64))], names=["word", "bits"])

    rows = keys.where(F.col(name).isNotNull()).mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    return KeyFilter(size, rows["word"].to_numpy(dtype=np.int64), rows["bits"].to_numpy(dtype=np.int64))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of each part hold about ``limit`` bytes; a row is never cut."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(sizes):
        return
    group = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(group)) + 1
    start = 0
    for end in [*edges.tolist(), len(sizes)]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def batches_of(rows: Iterable[tuple], schema: pa.Schema, limit: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``limit`` rows from tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def blank(column: str):
    """True where the text is null or holds nothing but white space."""
    return F.col(column).isNull() | ~F.col(column).rlike(r"(?U)\S")
