"""Deterministic embeddings without a model."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[a-z0-9]+")


class _Features(dict):
    """Word -> bucket and sign from its digest, as one number; emptied when it has grown large."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        digest = hashlib.md5(word.encode()).hexdigest()
        self[word] = code = 2 * (int(digest[:6], 16) % self.size) + int(digest[6], 16) % 2
        return code


@functools.cache
def _features(size: int) -> _Features:
    return _Features(size)


def _weights(texts: list[str | None], size: int) -> np.ndarray:
    """One row of signed bucket sums a text."""
    found = [_WORD.findall(text) if text else [] for text in texts]
    n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    code = np.fromiter(map(_features(size).__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(n.sum()))
    at = np.repeat(np.arange(len(texts)), n) * size + (code >> 1)
    return np.bincount(at, weights=1 - 2 * (code & 1), minlength=len(texts) * size).astype(np.int64).reshape(len(texts), size)


def hashed_features(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``key, bucket, weight``: words hashed into signed buckets; null texts and texts without words give no rows.

    One pass over Arrow batches where the rows lie: a row's words never leave it, so nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = _weights(batch.column("text").to_pylist(), size)
            row, bucket = np.nonzero(weights)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array(bucket), pa.array(weights[row, bucket])], names=["key", "bucket", "weight"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(count, f"key {kind}, bucket long, weight long").withColumnRenamed("key", key)


def embedded(df: DataFrame, text: str, into: str, size: int) -> DataFrame:
    """``df`` with ``into``: the hashed features of each text as a dense vector; one vector a row, so none can be lost.

    The function counts as nondeterministic, as a filter on the vector would else be pushed below it and compute it again.
    """

    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_weights(texts.tolist(), size).astype(np.float32)))

    return df.withColumn(into, vector.asNondeterministic()(F.lower(F.col(text))))
