"""Problem 4: text quality statistics and a verdict from a hidden Markov model over line statistics."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, slices
from .repeated_lines import repeated_lines
from .rolling import LETTER, Stream, kinds_and_lower

LABELS = ("prose", "list", "table", "junk")
#: Rates of all words from which a word is known, and common; so there are at most 1 / rate of each.
KNOWN_RATE, COMMON_RATE = 1e-6, 1e-3
#: Rounds of re-estimation after the seed labels.
ROUNDS = 1

# The observation of a line is a mixed-radix number of these categories.
CATEGORIES = (
    ("marker", 2), ("leader", 2), ("columns", 3), ("figures", 4), ("end", 4), ("start", 3), ("length", 5), ("common", 3), ("odd", 4), ("follows", 2), ("strung", 2),
)
RADIX = tuple(n for _, n in CATEGORIES)
CODES = int(np.prod(RADIX))

_MARKER = re.compile(r"\s*(?:[•*▪◦‣·–—-]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)])\s+\S").match
_LEADER = re.compile(r"\.{4,}\s*\S{0,6}\s*$|(?:\. ){4,}\s*\S{0,6}\s*$").search
_WIDE = re.compile(r" {2,}\S").findall
#: Lines that hold a page number, alone or beside a title; they stand between the lines of a text without being part of it.
_PAGE_NUMBER = re.compile(r"\s*(?:[-–—\[(]\s?)?(?:[Pp](?:age|\.)\s?)?(?:\d{1,6}|[ivxlc]{1,7})(?:\s?(?:/|of)\s?\d{1,6})?(?:\s?[-–—\])])?\s*").fullmatch
_NUMBERED_HEAD = re.compile(r"\s*(?:\d{1,6} {2,}(?:[A-ZÀ-Þ0-9][\w’'-]*|—)(?: +(?:[A-ZÀ-Þ0-9][\w’'-]*|—)){1,8}|[A-ZÀ-Þ][\w’'-]*(?: +(?:[A-ZÀ-Þ0-9][\w’'-]*|—)){1,8}(?: {2,}| \| )\d{1,6})\s*").fullmatch
_UNSEEN = np.array([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF], dtype=np.uint32)
_SPACES = (*range(0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_COMMON_SIGNS = ".,;:!?'\"()-–—’“”«»¿¡/%°"
#: Left-overs of texts decoded in the wrong encoding.
_DEBRIS = (0xC3, 0xC2, 0xE2, 0xEF, 0xBF, 0xBD, 0xFFFD, 0x20AC, 0x2122, 0x153, 0xAC, 0xB0)
SOLID, DIGIT, SYMBOL, DEBRIS = 1, 2, 4, 8
#: Characters that count as a word where a line has fewer words than that: junk and figures come without spaces.
CHARS_PER_WORD = 7
#: A line of so many words, of which less than this share are common, and without an end, strings key words together.
STRUNG_WORDS, STRUNG_SHARE = 20, 0.4
_TAIL = "\"'”»’)]"


def _words_of(codes: np.ndarray, kind: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and fingerprint of each run of letters."""
    letter = np.zeros(len(codes) + 2, dtype=np.int8)
    letter[1:-1] = kind == LETTER
    edge = np.diff(letter)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, end, Stream(low).spans(start, end)


@functools.cache
def _flags() -> np.ndarray:
    """Of each code point of the basic plane: whether it is solid, a figure, a symbol, debris."""
    kind, _ = kinds_and_lower(np.arange(0x10000, dtype=np.uint32))
    out = np.full(0x10000, SOLID, dtype=np.uint8)
    out[list(_SPACES)] = 0
    out[48:58] |= DIGIT
    plain = (out & SOLID == 0) | (out & DIGIT > 0) | (kind == LETTER)
    plain[[ord(c) for c in _COMMON_SIGNS]] = True
    out[~plain] |= SYMBOL
    out[list(_DEBRIS)] |= DEBRIS
    return out


def _decoded(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one string, and its code points without the invisible ones, with their kinds and lower case."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    far = np.flatnonzero(codes > 0xAC)
    if len(far):
        unseen = far[np.isin(codes[far], _UNSEEN)]
        if len(unseen):
            codes = np.delete(codes, unseen)
        wide = np.flatnonzero((codes > 0xFF00) & (codes < 0xFF5F))
        if len(wide):
            codes = codes.copy()
            codes[wide] -= np.uint32(0xFEE0)
    kind, low = kinds_and_lower(codes)
    return joined, codes, kind, low


def _gaps(line: str) -> int:
    """Marks between columns: tabs, bars, runs of spaces, commas and semicolons without the space of a sentence."""
    n = line.count("\t") + line.count("|")
    if "," in line:
        n += line.count(",") - line.count(", ") - line.endswith(",")
    if ";" in line:
        n += line.count(" ; ") + line.count(";") - line.count("; ") - line.endswith(";")
    return n + len(_WIDE(line)) if "  " in line else n


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for part in slices(batch, "text"):
            _, codes, kind, low = _decoded(part.column("text").to_pylist())
            found.append(_words_of(codes, kind, low)[2])
        if found:
            word, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def vocabulary(texts: DataFrame, known: float = KNOWN_RATE, common: float = COMMON_RATE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of the known and of the common words, counted over all texts (column ``text``)."""
    counted = texts.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    kept = counted.crossJoin(F.broadcast(total)).where((F.col("n") >= F.col("total") * known) & (F.col("n") >= 3))
    rows = kept.select("word", (F.col("n") >= F.col("total") * common).alias("common")).toPandas()
    word = rows["word"].to_numpy(dtype=np.int64)
    return np.sort(word), np.sort(word[rows["common"].to_numpy(dtype=bool)])


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(values), dtype=bool)
    place = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return listed[place] == values


def _per_line(owner: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights=weight, minlength=n)


def line_statistics(texts: list[str], known: np.ndarray, common: np.ndarray) -> dict[str, np.ndarray]:
    """Of each line that is not blank: row, number, observation, words and characters; and sums of its statistics."""
    joined, codes, kind, low = _decoded(texts)
    lines = joined.split("\n")[:-1]
    n = len(lines)
    breaks = np.flatnonzero(codes == 10)
    begin = np.concatenate(([0], breaks[:-1] + 1))
    counts = np.fromiter((t.count("\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    row = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts) + 1

    digit = (codes >= 48) & (codes <= 57)
    letter = kind == LETTER
    flags = _flags()[np.minimum(codes, 0xFFFF)]
    line_of = np.zeros(len(codes), dtype=np.int32)
    np.cumsum((codes == 10)[:-1], out=line_of[1:], dtype=np.int32)
    solid = (flags & SOLID).view(bool)
    digit = (flags & DIGIT) > 0
    add = lambda mask: np.add.reduceat(mask, begin, dtype=np.int32) if n else np.zeros(0, np.int32)
    chars, letters, symbols, mojibake = add(solid), add(kind == LETTER), add((flags & SYMBOL) > 0), add((flags & DEBRIS) > 0)

    w_start, w_end, word = _words_of(codes, kind, low)
    owner = line_of[w_start]
    words = _per_line(owner, n).astype(np.int64)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, owner, w_end - w_start)
    signed = word.view(np.int64)
    known_n, common_n = _per_line(owner, n, _among(signed, known)), _per_line(owner, n, _among(signed, common))

    t_start = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8)))) == 1)
    t_owner = line_of[t_start]
    tokens = _per_line(t_owner, n)
    digit_sum = np.zeros(len(codes) + 1, dtype=np.int32)
    np.cumsum(digit, out=digit_sum[1:], dtype=np.int32)
    t_end = np.flatnonzero(np.diff(np.concatenate((solid.view(np.int8), [0]))) == -1) + 1
    figures = _per_line(t_owner, n, digit_sum[t_end] > digit_sum[t_start])

    furniture = np.fromiter(
        ((len(x) < 20 and _PAGE_NUMBER(x) is not None) or ("  " in x or " | " in x) and len(x) < 90 and _NUMBERED_HEAD(x) is not None for x in lines), dtype=bool, count=n
    )
    blank = (chars == 0) | furniture
    first = np.zeros(n, dtype=np.int64)
    last = np.zeros(n, dtype=np.int64)
    first[t_owner[::-1]] = t_start[::-1]
    last[t_owner] = t_end - 1
    upper_first = low[first] != codes[first]
    start = np.where(kind[first] != LETTER, 2, np.where(upper_first, 1, 0))
    final = np.isin(codes[last], np.frombuffer(".!?…".encode("utf-32-le"), dtype=np.uint32))
    closing = np.isin(codes[last], np.frombuffer(_TAIL.encode("utf-32-le"), dtype=np.uint32))
    before = np.maximum(last - 1, 0)
    final |= closing & np.isin(codes[before], np.frombuffer(".!?…".encode("utf-32-le"), dtype=np.uint32))

    marker = np.fromiter((_MARKER(x) is not None for x in lines), dtype=bool, count=n)
    leader = np.fromiter(("...." in x and _LEADER(x) is not None or ". . . ." in x for x in lines), dtype=bool, count=n)
    gaps = np.fromiter((_gaps(x.strip()) for x in lines), dtype=np.int64, count=n)

    safe = np.maximum(words, 1)
    unknown = 1 - known_n / safe
    share = common_n / safe
    solid_n = np.maximum(chars, 1)
    odd = np.select(
        [(symbols > 0.35 * solid_n) & (chars >= 8) | (mojibake > 0.2 * solid_n) & (chars >= 6) | (longest >= 26) | (chars / np.maximum(tokens, 1) >= 22) & ~leader,
         (unknown >= 0.6) & (words >= 2) | (longest >= 20),
         (unknown >= 0.3) & (words >= 2)], [3, 2, 1], 0)
    keep = np.flatnonzero(~blank)
    prior = np.concatenate(([-1], keep[:-1]))
    after = np.concatenate((keep[1:], [-1]))
    within = (after >= 0) & (row[keep] == row[np.maximum(after, 0)])
    end = np.zeros(n, dtype=np.int64)  # a sentence end; else by the next line: none, in lower case, other
    end[keep] = np.where(final[keep], 0, np.where(~within, 1, np.where(start[np.maximum(after, 0)] == 0, 2, 3)))
    joined_on = np.zeros(n, dtype=bool)
    joined_on[keep] = (prior >= 0) & (row[keep] == row[np.maximum(prior, 0)]) & ~final[np.maximum(prior, 0)] & (start[keep] == 0)
    figure_share = figures / np.maximum(tokens, 1)
    observed = (
        marker, leader, np.minimum(gaps, 2), np.digitize(figure_share, (1e-9, 0.3, 0.5)), end, start,
        np.digitize(words, (1, 4, 8, 13)), np.digitize(share, (1e-9, 0.25)), odd, joined_on,
        (words >= STRUNG_WORDS) & (share < STRUNG_SHARE) & ~final & (gaps < 2) & (figure_share < 0.3),
    )
    code = np.zeros(n, dtype=np.int64)
    for values, size in zip(observed, RADIX):
        code = code * size + values
    return {
        "row": row[keep], "line_no": number[keep], "code": code[keep].astype(np.int32), "words": words[keep].astype(np.int32), "weight": np.maximum(tokens, chars // CHARS_PER_WORD)[keep].astype(np.int32), "chars": chars[keep].astype(np.int32),
        "letters": letters[keep], "symbols": symbols[keep], "final": final[keep].astype(np.int32), "common": common_n[keep].astype(np.int32),
    }


def unpacked(codes: np.ndarray) -> dict[str, np.ndarray]:
    out, rest = {}, codes.astype(np.int64)
    for name, size in reversed(CATEGORIES):
        out[name], rest = rest % size, rest // size
    return out


def seed_labels(codes: np.ndarray) -> np.ndarray:
    """Labels of lines that leave little doubt by themselves; -1 for the others."""
    o = unpacked(codes)
    out = np.full(len(codes), -1)
    sentence = (o["end"] == 0) & (o["length"] >= 3) & (o["common"] >= 1)
    running = ((o["follows"] == 1) | (o["end"] == 2)) & (o["length"] >= 2) & (o["common"] >= 1) & (o["columns"] < 2) & (o["figures"] <= 1)
    out[sentence | running] = 0
    bare = (o["end"] == 3) & (o["start"] != 0) & (o["follows"] == 0) & (o["columns"] < 2)
    out[(o["marker"] == 1) & (o["length"] <= 3) & (o["end"] != 0) & (o["figures"] <= 2)] = 1
    out[(o["marker"] == 0) & (o["length"] <= 2) & bare & (o["figures"] <= 1)] = 1
    out[(o["marker"] == 0) & (o["length"] == 3) & bare & (o["figures"] == 0)] = 1
    out[o["leader"] == 1] = 1
    columns = (o["columns"] == 2) & ((o["figures"] >= 2) | (o["common"] == 0))
    out[(o["leader"] == 0) & (o["marker"] == 0) & (o["end"] != 0) & ((o["figures"] == 3) | columns) & (o["length"] <= 3)] = 2
    out[o["strung"] == 1] = 3
    out[(o["odd"] == 3) | (o["odd"] == 2) & (o["common"] == 0) & (o["leader"] == 0) & (o["columns"] < 2)] = 3
    return out


class LineModel:
    """Start, transition and emission log probabilities; a line's emission is the product over its categories."""

    def __init__(self, first: np.ndarray, moves: np.ndarray, seen: np.ndarray):
        self.first = np.log((first + 1.0) / (first + 1.0).sum())
        moves = moves + moves.sum() * 0.002 + 1.0
        self.moves = np.log(moves / moves.sum(axis=1, keepdims=True))
        parts = unpacked(np.arange(CODES))
        self.emit = np.zeros((len(LABELS), CODES))
        for name, size in CATEGORIES:
            table = np.stack([np.bincount(parts[name], weights=s, minlength=size) for s in seen]) + 0.5
            table /= table.sum(axis=1, keepdims=True)
            self.emit += np.log(table)[:, parts[name]]

    def decode(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The most likely labels of many sequences at once, step by step over all that are long enough."""
        out = np.zeros(len(codes), dtype=np.int64)
        start = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order):
            return out
        start, size = start[order], lengths[order]
        score = self.first + self.emit[:, codes[start]].T
        back: list[np.ndarray] = []
        for t in range(1, int(size[0])):
            k = int(np.searchsorted(-size, -t, side="left"))  # sequences longer than t
            step = score[:k, :, None] + self.moves[None]
            back.append(step.argmax(axis=1))
            score[:k] = step.max(axis=1) + self.emit[:, codes[start[:k] + t]].T
        label = score.argmax(axis=1)
        out[start + size - 1] = label
        for t in range(int(size[0]) - 1, 0, -1):
            k = len(back[t - 1])
            label[:k] = back[t - 1][np.arange(k), label[:k]]
            out[start[:k] + t - 1] = label[:k]
        return out


def _counts(labels: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Starts, moves and observations of labelled lines, in one vector."""
    k = len(LABELS)
    start = (np.cumsum(lengths) - lengths)[lengths > 0]
    first = np.bincount(labels[start][labels[start] >= 0], minlength=k)
    same = np.ones(len(labels), dtype=bool)
    same[start] = False
    a, b = labels[:-1], labels[1:]
    pair = same[1:] & (a >= 0) & (b >= 0)
    moves = np.bincount(a[pair] * k + b[pair], minlength=k * k)
    told = labels >= 0
    seen = np.bincount(labels[told] * CODES + codes[told], minlength=k * CODES)
    return np.concatenate((first, moves, seen))


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _fit(lines: DataFrame, model: LineModel | None) -> LineModel:
    shared = lines.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            codes, lengths = _lists(batch, "code")
            if not len(codes):
                continue
            labels = seed_labels(codes) if shared.value is None else shared.value.decode(codes, lengths)
            counted = _counts(labels, codes, lengths)
            total = counted if total is None else total + counted
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    k = len(LABELS)
    total = np.zeros(k + k * k + k * CODES)  # this many numbers reach the driver, whatever the table
    rows = lines.select("code").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    total[rows["at"].to_numpy(dtype=np.int64)] = rows["n"]
    return LineModel(total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k :].reshape(k, CODES))


def quality(df: DataFrame, id_col: str = "ingest_id", source_col: str = "source_doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, label shares and a verdict of every row.

    ``n_words, mean_word_length, symbol_ratio, punct_line_share, common_share`` describe the whole text;
    ``prose, list, table, junk`` are the shares of its words (white space apart; a line without spaces counts as
    one word for every CHARS_PER_WORD characters) by the label of their line, without the lines repeated across
    the source; ``verdict`` is the largest of them, or
    "prose" unless more than half lies elsewhere. Null and blank texts have zeros, null shares and verdict "blank";
    so have texts of nothing but repeated lines.

    The labels come from a hidden Markov model whose observations are categories of line statistics. It is
    trained on all lines: first on those whose label is plain, then once more on its own labelling.
    """
    rows = df.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known, common = vocabulary(rows.select("text").where("text <> ''"))
    shared = df.sparkSession.sparkContext.broadcast((known, common))  # bounded by the rates

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, common = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                s = line_statistics(part.column("text").to_pylist(), known, common)
                n = part.num_rows
                size = np.bincount(s["row"], minlength=n)
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                each = [pa.ListArray.from_arrays(offsets, pa.array(s[k].astype(np.int32))) for k in ("line_no", "code", "words", "weight", "chars")]
                sums = [pa.array(np.bincount(s["row"], weights=s[k], minlength=n).astype(np.int64)) for k in ("letters", "symbols", "final", "common")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_id"), *each, *sums], names=["row_id", "line_no", "code", "words", "weight", "chars", "letters", "symbols", "final", "common"]
                )

    id_kind = df.schema[id_col].dataType.simpleString()
    lists = "line_no array<int>, code array<int>, words array<int>, weight array<int>, chars array<int>"
    measured = rows.mapInArrow(measure, f"row_id {id_kind}, {lists}, letters long, symbols long, final long, common long")
    repeated = repeated_lines(df, id_col, source_col, text_col).groupBy("row_id").agg(F.collect_set(F.col("line_no").cast("int")).alias("cut"))
    lines = cut_lineage(measured.join(repeated, "row_id", "left"))
    left = F.when(F.col("cut").isNull(), F.expr("transform(line_no, x -> true)")).otherwise(F.expr("transform(line_no, x -> NOT array_contains(cut, x))"))
    kept = lines.withColumn("_keep", left)
    own = kept.select(F.expr("filter(code, (x, i) -> _keep[i])").alias("code"))

    model = _fit(own, None)
    for _ in range(ROUNDS):
        model = _fit(own, model)
    fitted = df.sparkSession.sparkContext.broadcast(model)

    sums = ("n_words", "n_chars", "n_lines", "letters", "symbols", "final", "common")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, lengths = _lists(batch, "code")
            labels = fitted.value.decode(code, lengths)
            owner = np.repeat(np.arange(batch.num_rows), lengths)
            size = _lists(batch, "weight")[0]
            weight = np.stack([np.bincount(owner, weights=size * (labels == k), minlength=batch.num_rows) for k in range(len(LABELS))])
            total = weight.sum(axis=0)
            share = np.where(total > 0, weight / np.maximum(total, 1), np.nan)
            columns = [pa.array(share[k], from_pandas=True) for k in range(len(LABELS))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row_id", *sums)] + columns, names=["row_id", *sums, *LABELS])

    only = [F.expr(f"filter({c}, (x, i) -> _keep[i])").alias(c) for c in ("code", "weight")]
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    judged = kept.select(
        "row_id", whole("words").alias("n_words"), whole("chars").alias("n_chars"), F.size("line_no").cast("long").alias("n_lines"), *sums[3:], *only
    ).mapInArrow(judge, f"row_id {id_kind}, " + ", ".join(f"{x} long" for x in sums) + ", " + ", ".join(f"{x} double" for x in LABELS))
    rate = lambda part, of: F.coalesce(F.round(F.col(part) / F.nullif(F.col(of), F.lit(0)), 6), F.lit(0.0))
    verdict = (
        F.when(F.col("prose").isNull(), "blank").when(F.col("prose") >= 0.5, "prose")
        .otherwise(F.expr("array_max(array(struct(list AS n, 'list' AS v), struct(`table` AS n, 'table' AS v), struct(junk AS n, 'junk' AS v))).v"))
    )
    return judged.select(
        F.col("row_id").alias(id_col), "n_words", rate("letters", "n_words").alias("mean_word_length"), rate("symbols", "n_chars").alias("symbol_ratio"),
        rate("final", "n_lines").alias("punct_line_share"), rate("common", "n_words").alias("common_share"), *LABELS, verdict.alias("verdict"),
    )


def not_prose(df: DataFrame, id_col: str = "ingest_id", source_col: str = "source_doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` of the rows whose verdict is list, table or junk."""
    return quality(df, id_col, source_col, text_col).where(~F.col("verdict").isin("prose", "blank")).select(id_col)
