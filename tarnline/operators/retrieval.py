"""Exact similarity search of a question set against all vectors, in groups, and what follows a ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group of questions, which a task holds, and of a group of vectors, which flow past it.
QUESTION_BLOCK, VECTOR_BLOCK = 65_536, 131_072
#: Numbers in a group of questions at most, so that long vectors come in smaller groups.
BLOCK_NUMBERS = 4_000_000
#: Vectors are spread over so many groups at least, unless those would have fewer rows than this.
SPREAD, SPREAD_ROWS = 16, 8192
#: Products held at once, and pairs scored again at once.
TILE, PAIRS = 2**20, 2**16


def _rows(df: DataFrame, key: str, vector: str, scope: str | None) -> DataFrame:
    """The rows of a side as ``k, v, s``."""
    own = F.col(scope).cast("string") if scope else F.lit("")
    return df.select(F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v"), own.alias("s")).where("k IS NOT NULL AND s IS NOT NULL")


def _groups(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``s, qn, vn``: the groups of questions and of vectors of each scope. Of the vectors only keys are counted, so those computed on the way are computed once."""
    sized = asked.where("v IS NOT NULL").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.max(F.size("v")), F.lit(1)).alias("width"))
    each = F.least(F.lit(QUESTION_BLOCK), F.greatest(F.lit(64), F.floor(F.lit(BLOCK_NUMBERS) / F.col("width"))))
    counted = held.groupBy("s").agg(F.count(F.lit(1)).alias("m"))
    spread = F.least(F.lit(SPREAD), F.ceil(F.col("m") / F.lit(SPREAD_ROWS)))
    return sized.join(counted, "s").select("s", F.ceil(F.col("n") / each).alias("qn"), F.greatest(F.ceil(F.col("m") / F.lit(VECTOR_BLOCK)), spread).alias("vn"))


def _numbers(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(lists), -1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows, in double precision; a row with itself sums up in the same order as with its equals."""
    parts = [slice(i, i + PAIRS) for i in range(0, max(len(a), 1), PAIRS)]
    return np.concatenate([np.einsum("ij,ij->i", a[p].astype(np.float64), b[p].astype(np.float64)) for p in parts])


def _long(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a length, and the squared lengths of those."""
    squared = _dots(m, m)
    good = np.isfinite(squared) & (squared > 0)
    return good, squared[good]


class _Best:
    """The ``k`` best vectors so far of each question of a group.

    A product in single precision leaves out the pairs that cannot reach a question's k-th best score, by a bound on its
    error; the others are scored in double precision, so the ranking is that of double precision. Vectors come in the order of their ids.
    """

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int, v_kind: np.dtype):
        good, self.squared = _long(q)
        self.q_ids, self.q, self.k, self.seen = q_ids[good], q[good], k, 0
        self.unit = (self.q / np.sqrt(self.squared)[:, None]).astype(np.float32)
        self.slack = (q.shape[1] + 16) * 2.0**-23
        self.score, self.least = np.full((len(self.q), k), -np.inf), np.full(len(self.q), -np.inf)
        self.ids = np.full((len(self.q), k), "" if v_kind == object else 0, dtype=v_kind)

    def take(self, v_ids: np.ndarray, v: np.ndarray) -> None:
        good, squared = _long(v)
        v_ids, v = v_ids[good], v[good]
        while len(v_ids) and len(self.q):
            size = max(1024, self.seen)  # the bounds grow with what was seen
            self._slice(v_ids[:size], v[:size], squared[:size])
            self.seen += min(size, len(v_ids))
            v_ids, v, squared = v_ids[size:], v[size:], squared[size:]

    def _slice(self, v_ids: np.ndarray, v: np.ndarray, squared: np.ndarray) -> None:
        single, m = np.ascontiguousarray((v / np.sqrt(squared)[:, None]).astype(np.float32).T), len(v_ids)
        rows = min(max(16, TILE // m), len(self.q))
        # filled again and again, as fresh memory costs much of a product's time; eight marks are looked at as one number
        products, marks = np.empty((rows, m), dtype=np.float32), np.zeros((rows, -(-m // 8) * 8), dtype=bool)
        found, n = [], 0
        for a in range(0, len(self.q), rows):
            product = np.dot(self.unit[a : a + rows], single, out=products[: min(rows, len(self.q) - a)])
            least = self.least[a : a + rows]
            if not self.seen and self.k < m:
                least = np.partition(product, -self.k, axis=1)[:, -self.k].astype(np.float64) - self.slack
            marked = marks[: len(product)]
            np.greater_equal(product, (least - self.slack).astype(np.float32)[:, None], out=marked[:, :m])
            eight = np.flatnonzero(marked.view(np.uint64))
            at, place = np.nonzero(marked.reshape(-1, 8)[eight])
            row, col = np.divmod(eight[at] * 8 + place, marks.shape[1])
            if len(row) > 32 * self.k * len(product):  # of equal vectors only the first k by id can be among the best
                kept = self._few(v)[col]
                row, col = row[kept], col[kept]
            found.append((a + row, col))
            n += len(row)
            if n > PAIRS or a + rows >= len(self.q):
                row, col = (np.concatenate(f) for f in zip(*found))
                if n:
                    parts = [(row[i : i + PAIRS], col[i : i + PAIRS]) for i in range(0, n, PAIRS)]
                    dots = np.concatenate([_dots(self.q[r], v[c]) for r, c in parts])
                    self._merge(row, np.clip(dots / np.sqrt(self.squared[row] * squared[col]), -1, 1), v_ids[col])
                found, n = [], 0

    def _few(self, v: np.ndarray) -> np.ndarray:
        _, same = np.unique(v, axis=0, return_inverse=True)
        order = np.argsort(same.ravel(), kind="stable")
        same = same.ravel()[order]
        few = np.zeros(len(v), dtype=bool)
        few[order] = np.arange(len(v)) - np.searchsorted(same, same) < self.k
        return few

    def _merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """The best of the questions in ``row``, of those they have and the new ones; these follow by id, so a stable sort keeps ties by id."""
        met = np.unique(row)
        # a question's place and its score from above, to 12 digits, as one number
        new = (np.searchsorted(met, row) << 42) | (10**12 - np.rint(score * 1e12).astype(np.int64))
        own = self.score[met]
        old = (np.arange(len(met))[:, None] << 42) | np.where(own > -np.inf, 10**12 - np.rint(np.maximum(own, -1) * 1e12).astype(np.int64), 1 << 41)
        key, score, ids = np.concatenate([old.ravel(), new]), np.concatenate([own.ravel(), score]), np.concatenate([self.ids[met].ravel(), ids])
        order = np.argsort(key, kind="stable")
        place = key[order] >> 42
        order = order[np.arange(len(order)) - np.searchsorted(place, np.arange(len(met)))[place] < self.k].reshape(-1, self.k)
        self.score[met], self.ids[met] = score[order], ids[order]
        self.least[met] = np.round(self.score[met, -1], 12)

    def batch(self, names: list[str]) -> pa.RecordBatch:
        row, place = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.q_ids[row]), pa.array(self.ids[row, place]), pa.array(self.score[row, place])], names=names)


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """The parts of a batch of one cell and side: the cell, whether they are vectors, the part."""
    n = batch.num_rows
    cut = np.zeros(max(n - 1, 0), dtype=bool)
    for name in ("s", "qg", "vg", "held"):
        c = batch.column(name)
        cut |= pc.not_equal(c.slice(1), c.slice(0, max(n - 1, 0))).to_numpy(zero_copy_only=False).astype(bool)
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            cell = tuple(batch.column(name)[a].as_py() for name in ("s", "qg", "vg"))
            yield cell, batch.column("held")[a].as_py(), batch.slice(a, b - a)


def dense_topk(
    questions: DataFrame, vectors: DataFrame, k: int = 10, question_id: str = "query_id", vector_id: str = "id", embedding: str = "embedding", scope: str | None = None,
) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest vectors of each question by cosine, ties by id.

    Both sides are cut into groups of bounded size and every group of questions meets every group of vectors in a cell:
    a task holds the questions of a cell with their ``k`` best so far while its vectors flow past in batches, and a last
    ranking takes the best of all cells. With ``scope`` the groups are those of one value of that column, so questions
    meet only vectors with their own value; a null value has none. Vectors that are null or without length, and questions
    with such, give no rows; all vectors must have one dimension. Ids must be numbers or strings and are ranked as such.
    """
    asked, held = _rows(questions, question_id, embedding, scope), _rows(vectors, vector_id, embedding, scope)
    groups = _groups(asked, held)
    meet = (lambda rows: rows.join(groups, "s")) if scope else (lambda rows: rows.crossJoin(F.broadcast(groups.drop("s"))))  # of one row
    group = lambda n: F.pmod(F.xxhash64("k"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q_kind, v_kind = questions.schema[question_id].dataType.simpleString(), vectors.schema[vector_id].dataType.simpleString()
    left = meet(asked.where("v IS NOT NULL")).select("s", group("qn").alias("qg"), every("vn").alias("vg"), F.lit(False).alias("held"), F.col("k").alias("q_id"), F.lit(None).cast(v_kind).alias("v_id"), "v", "vn")
    right = meet(held.where("v IS NOT NULL")).select("s", every("qn").alias("qg"), group("vn").alias("vg"), F.lit(True).alias("held"), F.lit(None).cast(q_kind).alias("q_id"), F.col("k").alias("v_id"), "v", "vn")
    cells, tasks = left.unionByName(right), int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the cells of one scope are of about one size, so they are dealt out in turn
    dealt = cells.repartition("s", "qg", "vg") if scope else cells.repartitionById(tasks, F.pmod(F.col("qg") * F.col("vn") + F.col("vg"), F.lit(tasks)).cast("int"))
    names = [question_id, vector_id, "score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, best = None, [], None
        for batch in batches:
            for at, is_held, part in _spans(batch):
                if at != cell:
                    if best is not None:
                        yield best.batch(names)
                    cell, waiting, best = at, [], None
                ids = part.column("v_id" if is_held else "q_id").to_numpy(zero_copy_only=False)
                if not is_held:
                    waiting.append((ids, _numbers(part.column("v"))))
                elif best is not None or waiting:
                    if best is None:
                        best = _Best(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), k, ids.dtype)
                        waiting = []
                    best.take(ids, _numbers(part.column("v")))
        if best is not None:
            yield best.batch(names)

    best = Window.partitionBy(question_id).orderBy(F.round("score", 12).desc(), vector_id)
    return (
        dealt.drop("vn").sortWithinPartitions("vg", "qg", "s", "held", "v_id").mapInArrow(search, f"{question_id} {q_kind}, {vector_id} {v_kind}, score double")
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select(question_id, F.col("rank").cast("long").alias("rank"), vector_id, "score")
    )


def scoped_with_fallback(questions: DataFrame, vectors: DataFrame, k: int, scope: str, **names: str) -> DataFrame:
    """Scoped search, and for questions whose scope holds nothing the open one; ``route`` tells which was taken.

    Which scopes hold anything is read off the vectors' own column, so each question is searched once.
    """
    embedding = names.get("embedding", "embedding")
    long = F.exists(F.col(embedding), lambda x: x != 0)
    held = vectors.where(F.col(embedding).isNotNull() & long).select(F.col(scope).alias("_scope")).distinct()
    inside = dense_topk(questions, vectors, k, scope=scope, **names).withColumn("route", F.lit("source_scoped"))
    rest = questions.join(held, F.col(scope) == F.col("_scope"), "left_anti")
    return inside.unionByName(dense_topk(rest, vectors, k, **names).withColumn("route", F.lit("direct")))


def ordered_contexts(ranked: DataFrame, question_id: str, context: Column) -> DataFrame:
    """``contexts``: the context strings of each question in rank order; at most ``k`` of them, so the list is bounded."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("rank"), context.alias("context"))))
    return ranked.groupBy(question_id).agg(F.transform(pairs, lambda p: p["context"]).alias("contexts"))


def first_places(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order; unlike ``dropDuplicates`` it always keeps the same one."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def average_precision(verdicts: DataFrame, question_id: str, rank: str = "rank", hit: str = "hit") -> DataFrame:
    """``hits, average_precision``: the mean precision at the ranks of hits, 0 without one."""
    upto = Window.partitionBy(question_id).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum(F.col(hit).cast("long")).over(upto) / F.col(rank)
    return (
        verdicts.withColumn("_p", F.when(F.col(hit), at)).groupBy(question_id)
        .agg(F.sum(F.col(hit).cast("long")).alias("hits"), F.coalesce(F.avg("_p"), F.lit(0.0)).alias("average_precision"))
    )
