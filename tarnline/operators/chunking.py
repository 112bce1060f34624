"""Chunking of page texts: splitters, page spans, semantic cuts."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_END, chunk_id, sentences, squeezed
from ..functions.vector import cosine
from ..sources.lineage import cut_lineage
from .embedding import embedded
from .runs import following, percentiles, previous, running_sum

# The separators of the recursive splitter, coarse to fine.
SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does, with whole-piece overlap.

    A separator stays at the start of the piece that follows it; pieces are stripped and blank ones dropped.
    """
    level = next(i for i, s in enumerate(separators) if s == "" or s in text)
    mark, finer = separators[level], separators[level + 1 :]
    if mark:
        first, *others = text.split(mark)
        parts = [p for p in (first, *(mark + o for o in others)) if p]
    else:
        parts = list(text)
    out: list[str] = []
    waiting: list[str] = []
    for part in parts:
        if len(part) < size:
            waiting.append(part)
            continue
        out += _packed(waiting, size, overlap)
        waiting = []
        out += split_text(part, size, overlap, finer) if finer else [part]
    return out + _packed(waiting, size, overlap)


def _packed(parts: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: deque[str] = deque()
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            out.append("".join(held).strip())
            while total > overlap or (total and total + len(part) > size):
                total -= len(held.popleft())
        held.append(part)
        total += len(part)
    out.append("".join(held).strip())
    return [piece for piece in out if piece]


def split_rows(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """``key, piece_no, piece``: each text through the recursive splitter, numbered from 0; blank texts give no rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [split_text(t, size, overlap) if t else [] for t in batch.column("text").to_pylist()]
            at = pa.array([i for i, p in enumerate(pieces) for _ in p], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(at), pa.array([n for p in pieces for n in range(len(p))], pa.int64()), pa.array([x for p in pieces for x in p], pa.string())],
                names=["key", "piece_no", "piece"],
            )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, f"key {kind}, piece_no long, piece string").withColumnRenamed("key", key)


def capped(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """``key, piece_no, piece``: texts beyond ``limit`` split again without overlap; only those visit Python."""
    long = F.length(text) > limit
    short = df.where(~long & F.col(text).rlike(r"\S")).select(key, F.lit(0).cast("long").alias("piece_no"), F.col(text).alias("piece"))
    return short.unionByName(split_rows(df.where(long), key, text, limit, 0))


def sections(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """``key, section_no, section``: texts cut before each match of ``pattern``; what precedes the first is a piece too."""
    parts = F.filter(F.split(F.col(text), f"(?={pattern})"), lambda p: p.rlike(r"\S"))
    return df.select(key, F.posexplode(parts).alias("section_no", "section")).withColumn("section_no", F.col("section_no").cast("long"))


def records(df: DataFrame, key: str, text: str, header: str) -> DataFrame:
    """``key, record_no, record``: lines grouped into records, each from a line that begins with ``header`` to the next.

    ``header`` is a pattern. Lines before the first header are record 0. A text is cut in one projection.
    """
    cut = F.posexplode(F.split(F.col(text), rf"\n(?={header})"))
    first = F.col(text).rlike(f"^{header}").cast("long")
    return df.where(F.col(text).isNotNull()).select(key, first.alias("_first"), cut.alias("pos", "record")).select(
        key, (F.col("pos") + F.col("_first")).alias("record_no"), "record"
    )


def entries(df: DataFrame, key: str, text: str, marker: str, limit: int = 6000, fallback: int = 1500) -> DataFrame:
    """``key, piece_no, piece``: one piece an entry of a reference text whose entries hold ``marker`` in their head line.

    An entry begins with the line that holds the marker, or with the line before if the marker opens its line. What
    stands before the first entry, texts without one and entries beyond ``limit`` characters go through the splitter
    for prose; blank pieces are left out. Only those texts visit Python.
    """
    mark = re.escape(marker)
    opens = rf"[^\n]*\S[^\n]*{mark}|[^\n]*\n[^\S\n]*{mark}"
    parts = F.filter(F.split(F.col(text), rf"(?:(?<=\n)|^)(?={opens})"), lambda p: p.rlike(r"\S"))
    return _resplit(df, key, parts, lambda p: ~p.rlike(rf"^(?:{opens}|\s*{mark})") | (F.length(p) > limit), fallback)


def headed(df: DataFrame, key: str, text: str, pattern: str, limit: int = 6000, fallback: int = 1500) -> DataFrame:
    """``key, piece_no, piece``: one piece a section, whose head matches ``pattern`` in any case; texts without a head
    and sections beyond ``limit`` go through the splitter for prose, and what precedes the first head is one piece."""
    parts = F.filter(F.split(F.col(text), f"(?i)(?={pattern})"), lambda p: p.rlike(r"\S"))
    whole = ~F.col(text).rlike(f"(?i){pattern}")
    return _resplit(df, key, parts, lambda p: whole | (p.rlike(f"^(?i)(?:{pattern})") & (F.length(p) > limit)), fallback)


def _resplit(df: DataFrame, key: str, parts: Column, prose: Callable[[Column], Column], size: int) -> DataFrame:
    """The parts of each text, numbered once those where ``prose`` holds have been split; no row leaves its place."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [[x for t, p in zip(ts, ps) for x in (split_text(t, size, 0) if p else [t])] for ts, ps in zip(batch.column("parts").to_pylist(), batch.column("prose").to_pylist())]
            at = pa.array([i for i, p in enumerate(pieces) for _ in p], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(at), pa.array([n for p in pieces for n in range(len(p))], pa.int64()), pa.array([x for p in pieces for x in p], pa.string())], names=["key", "piece_no", "piece"]
            )

    kind = df.schema[key].dataType.simpleString()
    cut = df.where(F.size(parts) > 0).select(F.col(key).alias("key"), parts.alias("parts"), F.transform(parts, prose).alias("prose"))
    return cut.mapInArrow(split, f"key {kind}, piece_no long, piece string").withColumnRenamed("key", key)


def page_spans(pages: DataFrame, doc: str = "source_doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """``doc, page, start_at, end_at``: where each page lies in its document, counted without white space."""
    sized = pages.groupBy(doc, page).agg(F.sum(F.length(squeezed(F.coalesce(F.col(text), F.lit("")))).cast("long")).alias("n"))
    return running_sum(sized, doc, page, "n", "end_at").select(doc, page, (F.col("end_at") - F.col("n")).alias("start_at"), "end_at")


def start_offsets(df: DataFrame, key: str, pieces: Column) -> DataFrame:
    """``key, piece_no, piece, offset``: where each piece of a text's array of pieces begins, counted without white space.

    Pieces cover their text but for white space, so the lengths before a piece add up to its place; the sums are taken
    inside the row.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, sizes = batch.column("pieces"), batch.column("sizes").flatten().to_numpy(zero_copy_only=False)
            count = np.diff(held.offsets.to_numpy())
            first = np.cumsum(count) - count
            upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            row = np.repeat(np.arange(len(count)), count)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row)), pa.array(np.arange(len(row)) - first[row]), held.flatten(), pa.array(upto[:-1] - upto[first[row]])], names=["key", "piece_no", "piece", "offset"]
            )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), pieces.alias("pieces")).where(F.col("pieces").isNotNull())
    sized = rows.withColumn("sizes", F.transform("pieces", lambda p: F.length(squeezed(p)).cast("long")))
    return sized.mapInArrow(place, f"key {kind}, piece_no long, piece string, offset long").withColumnRenamed("key", key)


def sentence_windows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n, sentence, window``: each sentence with its neighbours on either side, within its row."""
    own = F.col("_s")
    window = F.transform(own, lambda s, i: F.array_join(F.slice(own, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " "))
    each = df.where(F.col(text).isNotNull()).select(key, sentences(F.col(text)).alias("_s")).select(key, F.posexplode(F.arrays_zip(own.alias("sentence"), window.alias("window"))).alias("n", "_z"))
    return each.select(key, F.col("n").cast("long").alias("n"), F.col("_z.sentence").alias("sentence"), F.col("_z.window").alias("window"))


def semantic_groups(vectors: DataFrame, doc: str, order: str, embedding: str, rate: float = 0.95) -> DataFrame:
    """``doc, order, chunk_no``: neighbours stay together unless their distance is above the document's percentile.

    ``order`` is an integer, unique in its document. Neighbours, the percentile and the numbers of the chunks are
    found by blocks (``runs``), so a document of any size is spread over tasks; vectors move once.
    """
    near = following(vectors.select(doc, order, embedding), doc, [order], embedding, "_next")
    apart = cut_lineage(near.select(doc, order, (F.lit(1.0) - cosine(F.col(embedding), F.col("_next"))).alias("_d")))  # numbers only, read thrice
    limit = percentiles(apart, doc, "_d", {"_limit": rate}).withColumnRenamed(doc, "_doc")
    held = apart.join(limit, F.col(doc).eqNullSafe(F.col("_doc")), "left").withColumn("_far", (F.round("_d", 9) > F.round("_limit", 9)).cast("long"))
    after = previous(held.select(doc, order, "_far"), doc, [order], "_far", "_cut")
    return running_sum(after.withColumn("_cut", F.coalesce("_cut", F.lit(0).cast("long"))), doc, order, "_cut", "chunk_no").select(doc, order, "chunk_no")


#: Width of a step by which offsets meet the pages that cover it.
PAGE_STEP = 4096


def start_pages(pieces: DataFrame, spans: DataFrame, doc: str, offset: str, into: str = "page") -> DataFrame:
    """``pieces`` with the page on which each begins: the one whose span holds ``offset``, else the document's last.

    ``spans`` has ``doc, page, start_at, end_at``. The range join is one by equality on steps of the offset.
    """
    covered = spans.where("end_at > start_at").select(
        F.col(doc).alias("_doc"), F.col("page").alias("_page"), "start_at", "end_at", F.explode(F.sequence(F.floor(F.col("start_at") / PAGE_STEP), F.floor((F.col("end_at") - 1) / PAGE_STEP))).alias("_step")
    )
    last = spans.groupBy(F.col(doc).alias("_own")).agg(F.max("page").alias("_last"))
    inside = (F.col(doc) == F.col("_doc")) & (F.floor(F.col(offset) / PAGE_STEP) == F.col("_step")) & F.col(offset).between(F.col("start_at"), F.col("end_at") - 1)
    placed = pieces.join(covered, inside, "left").join(last, F.col(doc) == F.col("_own"), "left")
    return placed.withColumn(into, F.coalesce("_page", "_last")).drop("_doc", "_page", "start_at", "end_at", "_step", "_own", "_last")


def document_sentences(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """``doc, n, sentence``: the sentences of each document over its pages, one row a (doc, page), numbered from 1.

    A page ends inside a sentence unless its last sentence is closed; then the next page's first one goes on with it.
    """
    cut = F.filter(F.split(F.col(text), SENTENCE_END), lambda s: s.rlike(r"\S"))
    parts = pages.select(doc, page, cut.alias("_s")).where(F.size("_s") > 0).select("*", (~F.element_at("_s", -1).rlike(r"[.?!]\s*$")).cast("long").alias("_open"))
    tied = previous(parts, doc, [page], "_open", "_goes_on")
    tied = tied.withColumn("_new", F.size("_s") - F.coalesce("_goes_on", F.lit(0)))
    placed = running_sum(tied, doc, page, "_new", "_upto")
    each = placed.select(doc, page, (F.col("_upto") - F.size("_s") + 1).alias("_first"), F.posexplode("_s").alias("_pos", "_part")).select(doc, (F.col("_first") + F.col("_pos")).alias("n"), page, "_part")
    joined = F.transform(F.array_sort(F.collect_list(F.struct(page, "_part"))), lambda x: x["_part"])  # the parts of one sentence
    return each.groupBy(doc, "n").agg(F.array_join(joined, "\n").alias("sentence"))


def semantic_build(pages: DataFrame, doc: str = "source_doc_id", page: str = "page", text: str = "text", limit: int = 6000, size: int = 64) -> DataFrame:
    """``doc, chunk_index, id, page, text``: the chunks of documents, cut where the sense of their sentences turns.

    ``pages`` has one row a (doc, page). Sentences with their neighbours are embedded; a cut falls where neighbouring
    windows are farther apart than the document's 95th percentile; chunks beyond ``limit`` characters are split again.
    ``page`` is where a chunk begins, ``chunk_index`` counts the chunks of a document from 0 and ``id`` is made of
    both. Documents without text give no rows. No document is held whole: all steps run by blocks of its order.
    """
    own = pages.where(F.col(doc).isNotNull() & F.col(page).isNotNull()).select(doc, page, F.coalesce(F.col(text), F.lit("")).alias(text))
    said = cut_lineage(document_sentences(own, doc, page, text))
    around = following(previous(said, doc, ["n"], "sentence", "_before"), doc, ["n"], "sentence", "_after")
    windows = embedded(around.select(doc, "n", F.concat_ws(" ", "_before", "sentence", "_after").alias("_window")), "_window", "_vector", size)
    groups = semantic_groups(cut_lineage(windows.drop("_window")), doc, "n", "_vector")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda x: x["sentence"])  # a run of sentences between two cuts
    chunks = said.join(groups, [doc, "n"]).groupBy(doc, "chunk_no").agg(F.array_join(ordered, " ").alias("_chunk"))
    pieces = capped(chunks.withColumn("_key", F.struct(F.col(doc).alias("d"), F.col("chunk_no").alias("c"))), "_key", "_chunk", limit)
    pieces = cut_lineage(pieces.select(F.col("_key.d").alias(doc), F.col("_key.c").alias("chunk_no"), "piece_no", "piece", F.length(squeezed(F.col("piece"))).cast("long").alias("_chars")))
    totals = pieces.groupBy(doc, "chunk_no").agg(F.count(F.lit(1)).alias("_k"), F.sum("_chars").alias("_n"))
    upto = running_sum(running_sum(totals, doc, "chunk_no", "_k", "_upto_k"), doc, "chunk_no", "_n", "_upto_n")
    base = upto.select(doc, "chunk_no", (F.col("_upto_k") - F.col("_k")).alias("_index"), (F.col("_upto_n") - F.col("_n")).alias("_at"))
    inside = Window.partitionBy(doc, "chunk_no").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)  # pieces of one chunk
    placed = pieces.withColumn("_before", F.coalesce(F.sum("_chars").over(inside), F.lit(0).cast("long"))).join(base, [doc, "chunk_no"])
    placed = placed.select(doc, (F.col("_index") + F.col("piece_no")).alias("chunk_index"), (F.col("_at") + F.col("_before")).alias("_offset"), F.col("piece").alias(text))
    found = start_pages(placed, page_spans(own, doc, page, text), doc, "_offset", page)
    return found.select(doc, "chunk_index", chunk_id(F.col(doc), F.col(page), F.col("chunk_index")).alias("id"), page, text)
