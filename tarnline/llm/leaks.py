"""Problem 7: evaluation texts leaking into training text, by a positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyFilter, cut_lineage, key_filter, slices
from .rolling import LETTER, Stream, kinds_and_lower

#: Share of an item's words that must stand in the document in order.
MIN_SHARE = 0.5
#: Anchors: of each run of ANCHOR_SPAN terms of an item, the ANCHORS_EACH that stand in fewest documents; of an item of
#: SHORT_ITEM terms or fewer all.
ANCHOR_SPAN, ANCHORS_EACH, SHORT_ITEM = 6, 2, 24
#: Share of an item's anchors, and their number where it has so many, that a document must hold to be compared word by word.
ANCHOR_SHARE, ANCHORS_LEAST = 0.15, 2
#: A matching piece has at least MIN_RUN words, or all of a shorter item, and no more than MAX_GAP others between two of them.
MIN_RUN, MAX_GAP = 4, 2
#: Rows up to which the anchors and candidates are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and fingerprint of every word of texts in order; a word is a run of letters and figures, case apart."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind, low = kinds_and_lower(codes)
    solid = (kind == LETTER) | ((codes >= 48) & (codes <= 57))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    return row, Stream(low).spans(start, end).view(np.int64)


def terms_of(row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and fingerprint of the terms: pairs of neighbouring words of a row.

    A term is the list of two words intersected at an offset of one.
    """
    if len(word) < 2:
        return row[:0], row[:0], word[:0]
    own = word.view(np.uint64)
    paired = row[1:] == row[:-1]
    term = (own[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (own[1:] + (own[1:] >> np.uint64(7)))
    first = np.searchsorted(row, row[:-1])
    return row[:-1][paired], (np.arange(len(row) - 1) - first)[paired], term[paired].view(np.int64)


def matched(doc: np.ndarray, item: np.ndarray, min_run: int = MIN_RUN, max_gap: int = MAX_GAP) -> tuple[int, int, int, int]:
    """Words of ``item`` that stand in ``doc`` in order, in pieces matched nearly word for word; words of the longest
    exact phrase; and the first and last word in ``doc`` of the pieces taken (-1 without any).

    Positions of equal words with one offset form a piece as long as no more than ``max_gap`` words differ
    between two of them; the best chain of pieces in order in both texts is taken.
    """
    min_run = min(min_run, len(item))
    by = np.argsort(item, kind="stable")
    low, high = np.searchsorted(item[by], doc, "left"), np.searchsorted(item[by], doc, "right")
    n = high - low
    if not n.any():
        return 0, 0, -1, -1
    d = np.repeat(np.arange(len(doc)), n)
    i = by[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(d))]
    offset = d - i
    order = np.lexsort((i, offset))
    i, offset = i[order], offset[order]
    same = offset[1:] == offset[:-1]
    step = i[1:] - i[:-1]

    def runs(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(~linked)
        return np.concatenate(([0], edge + 1)), np.concatenate((edge, [len(i) - 1]))

    begin, end = runs(same & (step == 1))
    exact = int((end - begin).max()) + 1
    begin, end = runs(same & (step <= max_gap + 1))
    size, first, last, off = end - begin + 1, i[begin], i[end], offset[begin]
    kept = np.flatnonzero((size >= min_run) & (2 * size > last - first + 1))
    kept = kept[np.lexsort((size[kept], off[kept], last[kept], first[kept]))]
    size, first, last, off = size[kept], first[kept], last[kept], off[kept]
    best, head, tail = size.copy(), first + off, last + off
    for k in range(1, len(kept)):
        # words of this piece that an earlier one covers do not count twice
        cut = np.maximum(0, np.maximum(last[:k] - first[k] + 1, last[:k] + off[:k] - (first[k] + off[k]) + 1))
        gain = np.where((cut < size[k]) & (first[:k] < first[k]) & (last[:k] < last[k]) & (last[:k] + off[:k] < last[k] + off[k]), best[:k] + size[k] - cut, 0)
        j = int(gain.argmax())
        if gain[j] > best[k]:
            best[k], head[k] = gain[j], head[j]
    if not len(best):
        return 0, exact, -1, -1
    k = int(best.argmax())
    return int(best[k]), exact, int(head[k]), int(tail[k])


def postings(df: DataFrame, id_col: str, text_col: str, only: KeyFilter | None = None) -> DataFrame:
    """The index: ``key, pos, term`` of every term of every text, or of the terms that pass ``only``."""
    shared = df.sparkSession.sparkContext.broadcast(only)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, pos, term = terms_of(*words_of(part.column("text").to_pylist()))
                if shared.value is not None:
                    held = shared.value.holds(term)
                    row, pos, term = row[held], pos[held], term[held]
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), pa.array(pos), pa.array(term)], names=["key", "pos", "term"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(index, f"key {kind}, pos long, term long")


def worded(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, words, n_words``: the words of each text, as fingerprints."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, word = words_of(part.column("text").to_pylist())
                offsets = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(word)), pa.array(np.diff(offsets).astype(np.int64))], names=["item", "words", "n_words"]
                )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(cut, f"item {kind}, words array<long>, n_words long").where("n_words > 1")


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is small enough, checked by a count."""
    return F.broadcast(df) if df.count() <= limit else df


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", min_share: float = MIN_SHARE,
) -> DataFrame:
    """``doc_id, item_id, matched, n_words, phrase, first_word, last_word`` of documents that hold at least
    ``min_share`` of an item's words in order: the words matched nearly word for word, those of the longest exact
    phrase, and where in the document the matched pieces begin and end (in words from 0).

    1. Terms are pairs of neighbouring words. The positional postings of the corpus are stored, in the checkpoint
       folder, for all terms that pass a filter of the items' terms (bounded bits, so it works alike for any number
       of items). Document frequencies from the postings give each item's rarest terms.
    2. The postings of those anchors are intersected after subtracting the item's position: a document is a
       candidate for an item if it holds enough of its anchors.
    3. Candidates alone are compared word by word over the whole text.

    Null and empty texts and items, and items of one word, give no rows; documents under a repeated id count as one
    document for the anchors and each give their own rows; ties between equally rare terms go to the earlier.
    """
    corpus = docs.select(F.col(doc_id).alias("doc"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    item_words = cut_lineage(worded(items, item_id, text_col))
    item_terms = cut_lineage(postings(items.select(F.col(item_id).alias("item"), F.col(text_col).alias("t")), "item", "t").select(F.col("key").alias("item"), F.col("pos").alias("ipos"), "term"))
    index = cut_lineage(postings(corpus, "doc", "text", key_filter(item_terms.select("term").distinct())))

    frequency = index.select("term", "key").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    span = Window.partitionBy("item", F.floor(F.col("ipos") / ANCHOR_SPAN)).orderBy("docs", "ipos")
    ranked = item_terms.join(frequency, "term").join(item_words.select("item", "n_words"), "item").withColumn("_nth", F.row_number().over(span))
    short = F.col("n_words") <= SHORT_ITEM + 1
    anchors = sized(cut_lineage(ranked.where((F.col("_nth") <= ANCHORS_EACH) | short).select("item", "ipos", "term")))
    terms = F.col("n_words") - 1
    anchor_count = item_words.select("item", F.when(short, terms).otherwise(F.ceil(terms / ANCHOR_SPAN) * ANCHORS_EACH).alias("anchors"))

    agreed = (
        index.join(anchors, "term")
        .groupBy("key", "item", (F.col("pos") - F.col("ipos")).alias("offset")).agg(F.collect_set("ipos").alias("at"))
        .groupBy("key", "item").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("held"))
        .join(anchor_count, "item").where(F.col("held") >= F.least("anchors", F.greatest(F.lit(ANCHORS_LEAST), F.col("anchors") * ANCHOR_SHARE)))
        .select(F.col("key").alias("doc"), "item")
    )
    pairs = corpus.join(sized(cut_lineage(agreed)), "doc").join(item_words, "item")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, word = words_of(part.column("text").to_pylist())
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                items = part.column("words").flatten().to_numpy(zero_copy_only=False)
                edge = np.cumsum([0, *part.column("n_words").to_pylist()])
                got = np.array([matched(word[at[k] : at[k + 1]], items[edge[k] : edge[k + 1]]) for k in range(part.num_rows)], dtype=np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("item"), part.column("n_words"), *map(pa.array, np.ascontiguousarray(got.T))],
                    names=["doc", "item", "n_words", "matched", "phrase", "first_word", "last_word"],
                )

    kinds = [docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    return (
        pairs.select("doc", "item", "n_words", "text", "words")
        .mapInArrow(compare, f"doc {kinds[0]}, item {kinds[1]}, n_words long, matched long, phrase long, first_word long, last_word long")
        .where(F.col("matched") >= F.col("n_words") * min_share)
        .select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "matched", "n_words", "phrase", "first_word", "last_word")
    )
