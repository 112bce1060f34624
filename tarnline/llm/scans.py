"""Problem 5: repair of text read from scanned pages.

Lines of scanned pages become rows. Page furniture is found by masking digits and counting the masked lines; SQL
windows join each line to the next one that is not furniture and give every word its neighbours; words without
standing on clean pages are grouped with known words by their confusable-glyph skeleton and replaced by the one
that their neighbours support.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, slices

#: Rate among the words of clean pages from which a word stands as it is, and the least count.
KNOWN_RATE, KNOWN_LEAST = 2e-6, 3
#: A scanned page is set in one width: of its body lines up to this share may be longer than WIDE characters and than
#: WIDE_FACTOR times their median.
WIDE, WIDE_FACTOR, WIDE_SHARE = 85, 1.5, 0.1
#: A running head recurs on this share of the scanned pages of its source that differ, and on so many at least.
HEAD_SHARE, HEAD_PAGES = 0.002, 2

# Glyphs that scanning confuses, each by its prototype; longer ones are strokes that run together.
STROKES = (("h", "ii"), ("b", "ii"), ("6", "ii"), ("8", "ii"), ("u", "ii"), ("m", "rri"), ("n", "ri"), ("d", "ei"), ("w", "vv"))
LETTERS = (("1l|!j", "i"), ("0o", "a"), ("c", "e"), ("f", "t"), ("5", "s"), ("9q", "g"), ("y", "v"), ("2", "z"))
#: Readings of letters inside a number.
FIGURES = ("oilsbgzq|", "011589291")

_BROKEN = "-¬‐‑­"
_NUMBER_LINE = r"^\s*(?:[\[(—–-]\s?)?(?:[Pp](?:[ao]ge|\.)\s?)?(?:[0-9lIoOsSbB]{1,6}|[ivxlcIVXLC]{1,7})(?:\s?/\s?[0-9lIoOsSbB]{1,6})?(?:\s?[\])—–-])?\.?\s*$"
_NUMBERED = r"^\s*[0-9lIoOsSbB]{1,6}\s{2,}\S|\S\s{2,}[0-9lIoOsSbB]{1,6}\s*$|\s\|\s[0-9lIoOsSbB]{1,6}\s*$"
_HEAD = r"^\s*(?:(?:[\p{Lu}0-9|l][\p{L}\p{N}’'/&-]*|[—–|&-])\s+){0,9}(?:[\p{Lu}0-9|l][\p{L}\p{N}’'/&-]*)\s*$"


_NOT_BODY = re.compile(
    r"\s*(?:[\[(—–-]\s?)?(?:[Pp](?:age|\.)\s?)?(?:\d{1,6}|[ivxlc]{1,7})(?:\s?/\s?\d{1,6})?(?:\s?[\])—–-])?\.?\s*|\s*(?:(?:[A-ZÀ-Þ0-9|l][\w’'/&-]*|[—–|&-])\s+){0,9}[A-ZÀ-Þ0-9|l][\w’'/&-]*\s*"
).fullmatch
_COLUMNS = re.compile(r"\S {3,}\S|\t| [|;] |^[|•*] ?|^\(?(?:\d{1,3}|[a-zA-Z])[.)] |,\S+,\S").search


def is_scanned(text: str) -> bool:
    """Whether a text has the layout of a scanned page: sentences run on over short lines of its body."""
    body = [x for x in map(str.strip, text.split("\n")) if x and not _NOT_BODY(x)]
    if len(body) < 2:
        return False
    limit = max(WIDE, WIDE_FACTOR * sorted(map(len, body))[len(body) // 2])
    if sum(1 for x in body if len(x) > limit) > WIDE_SHARE * len(body) or 2 * sum(1 for x in body if len(x) > WIDE) > len(body):
        return False
    runs = sum(1 for a, b in zip(body, body[1:]) if a[-1] not in ".!?:;" and b[0].islower() and a.count(" ") >= 3)
    if not runs or runs < 0.3 * (len(body) - 1) or sum(1 for x in body if _COLUMNS(x)) > 0.2 * len(body):
        return False
    parts = [p for x in body for p in x.split()]
    figures = sum(1 for p in parts if p[0].isdigit())
    return figures <= 0.3 * len(parts) and len(parts) - figures >= 4.5 * (len(body) - 1) and sum(map(len, parts)) <= 9 * len(parts)


class _Plain(dict):
    """Raw token -> its plain form: lower case, without punctuation around it."""

    strip = re.compile(r"^[\W_]+|[\W_]+$")

    def __missing__(self, raw: str) -> str:
        if len(self) > 300_000:
            self.clear()
        self[raw] = out = self.strip.sub("", raw.lower())
        return out


def _clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (``a`` null) and of neighbouring words on pages that are not scanned; numbers are ``#`` as neighbours."""
    plain = _Plain()
    for batch in batches:
        ids: dict[str, int] = {"": 0}
        singles, pairs = [], []
        for part in slices(batch, "text"):
            raw: list[str] = []
            for text in part.column("text").to_pylist():
                if not is_scanned(text):
                    raw += text.split()
                    raw.append("")
            tokens = list(map(plain.__getitem__, raw))
            at = np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), dtype=np.int64, count=len(tokens))
            singles.append(at)
            if len(at) > 1:
                pairs.append((at[:-1] << 32) | at[1:])
        names = np.array(list(ids), dtype=object)
        role = np.array([t if not t[:1].isdigit() else "#" for t in ids], dtype=object)
        one, n_one = np.unique(np.concatenate(singles), return_counts=True) if singles else (np.zeros(0, np.int64),) * 2
        two, n_two = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64),) * 2
        a, b = two >> 32, two & 0xFFFFFFFF
        yield pa.RecordBatch.from_arrays(
            [pa.array([None] * len(one) + role[a].tolist(), pa.string()), pa.array(names[one].tolist() + role[b].tolist(), pa.string()), pa.array(np.concatenate((n_one, n_two)))],
            names=["a", "b", "n"],
        )


def _scanned_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, numbers, texts = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            if is_scanned(text):
                lines = text.split("\n")
                rows += [i] * len(lines)
                numbers += range(1, len(lines) + 1)
                texts += lines
        taken = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(taken) for c in ("row_id", "source", "page")), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())],
            names=["row_id", "source", "page", "line_no", "line"],
        )


def skeleton(word: Column) -> Column:
    """The confusable-glyph skeleton: words that scanning may take for each other have the same."""
    out = word
    for glyphs, prototype in LETTERS:
        out = F.translate(out, glyphs, prototype * len(glyphs))
    for glyph, strokes in STROKES:
        out = F.replace(out, F.lit(glyph), F.lit(strokes))
    return out


def plain(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def with_furniture(lines: DataFrame) -> DataFrame:
    """``lines`` with ``furniture``: page numbers, and running heads and feet.

    A head has the shape of a title, and its text with digits masked recurs on other pages of its source, or it
    bears the page number, or stands at the edge of the page or beside a page number. A page is known by its text,
    so a page that was read twice counts once.
    """
    run = Window.partitionBy("row_id").orderBy("line_no")
    lines = lines.withColumn("para", F.sum((~F.col("line").rlike(r"\S")).cast("int")).over(run))
    masked = F.trim(F.regexp_replace(skeleton(F.lower(F.regexp_replace("line", r"\d+", ""))), r"[^\p{L}]+", " "))
    shaped = lines.where(F.col("line").rlike(r"\S")).select(
        "*", F.col("line").rlike(_NUMBER_LINE).alias("number"), F.col("line").rlike(_NUMBERED).alias("numbered"),
        (F.col("line").rlike(_HEAD) & F.col("line").rlike(r"\p{Lu}")).alias("head"), masked.alias("masked"),
    )
    pages = lines.select("source", "page").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    recurring = (
        shaped.where("head AND NOT number").select("source", "masked", "page").distinct().groupBy("source", "masked").agg(F.count(F.lit(1)).alias("times"))
        .join(pages, "source").where(F.col("times") >= F.greatest(F.lit(HEAD_PAGES), F.col("pages") * HEAD_SHARE)).select("source", "masked", "times")
    )
    page = Window.partitionBy("row_id").orderBy("line_no")
    whole = Window.partitionBy("row_id")
    placed = shaped.join(recurring, ["source", "masked"], "left").withColumns({
        "before": F.lag("number").over(page), "after": F.lead("number").over(page),
        "heads": F.avg((F.col("head") & ~F.col("number")).cast("int")).over(whole),
        "edge": (F.row_number().over(page) <= 2) | (F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("line_no"))) <= 2),
    })
    supported = (
        (F.col("times").isNotNull() & (F.col("heads") <= 0.5)) | F.col("numbered") | F.coalesce("before", F.lit(False)) | F.coalesce("after", F.lit(False)) | F.col("edge")
    )
    return placed.select(
        "row_id", "line_no", "para", "line", (F.col("number") | (F.col("head") & supported & (F.col("heads") <= 0.5))).alias("furniture")
    )


def flowing_words(lines: DataFrame) -> DataFrame:
    """Words of the body in reading order: ``row_id, line_no, pos, para, broken, left, right, raw, raw_right, before, after``.

    A word broken over a line end is one word of the line where it starts, with its halves in ``left`` and
    ``right``, whatever furniture stands between; whole words have a null ``right``. The raw columns hold the same
    with case and punctuation.
    """
    page = Window.partitionBy("row_id").orderBy("line_no")
    body = lines.where(~F.col("furniture")).select("row_id", "line_no", "para", F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line"))
    broken = F.col("line").rlike(rf"[\p{{L}}\p{{N}}][{_BROKEN}]$") & F.col("next").rlike(r"^[\p{L}\p{N}]")
    tied = body.withColumn("next", F.lead("line").over(page)).withColumn("broken", F.coalesce(broken, F.lit(False)))
    tied = tied.withColumn("taken", F.coalesce(F.lag("broken").over(page), F.lit(False)))
    parts = F.split("line", " ")
    own = F.when(F.col("taken"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    words = (
        tied.withColumn("parts", own).select("row_id", "line_no", "para", "broken", F.split("next", " ")[0].alias("head"), F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "word"))
        .withColumn("cut", F.col("broken") & (F.col("pos") == F.col("n") - 1))
    )
    left = F.when(F.col("cut"), F.regexp_replace("word", rf"[{_BROKEN}]$", "")).otherwise(F.col("word"))
    words = words.select(
        "row_id", "line_no", "pos", "para", F.col("cut").alias("broken"), plain(left).alias("left"), F.when(F.col("cut"), plain(F.col("head"))).alias("right"),
        left.alias("raw"), F.when(F.col("cut"), F.col("head")).alias("raw_right"),
    )
    order = Window.partitionBy("row_id").orderBy("line_no", "pos")
    whole = F.when(F.col("broken"), F.concat("left", "right")).otherwise(F.col("left"))
    role = F.when(whole.rlike(r"^\d"), "#").otherwise(whole)
    return words.withColumns({"before": F.coalesce(F.lag(role).over(order), F.lit("")), "after": F.coalesce(F.lead(role).over(order), F.lit(""))})


def repaired_words(words: DataFrame, counts: DataFrame) -> DataFrame:
    """``row_id, line_no, pos, fix`` of the broken and the misread words."""
    words = words.drop("para", "raw", "raw_right")
    known = counts.where("a IS NULL").select(F.col("b").alias("form"), F.col("n").alias("form_n"))
    pairs = counts.where("a IS NOT NULL")
    # Whole words that are known stay; there are at most 1 / KNOWN_RATE known words, so their set may be broadcast.
    whole = words.where(~F.col("broken") & ~F.col("left").rlike(r"^[\d.,/:-]*$"))
    strange = whole.join(F.broadcast(known.select("form")), F.col("left") == F.col("form"), "left_anti")
    words = cut_lineage(strange.unionByName(words.where("broken")).withColumn("key", F.concat_ws("\n", "left", "right")))
    halves = F.split("key", "\n")
    ways = F.when(F.size(halves) == 1, halves).otherwise(F.array(F.array_join(halves, ""), F.array_join(halves, "-")))
    forms = words.where("left <> ''").select("key").distinct().select("key", F.explode(ways).alias("read"))
    # Every way to read a distinct word: whole as it stands, if that is known; else the known words of its skeleton.
    standing = forms.join(known.withColumn("read", F.col("form")), "read").select("key", "read", "form", "form_n", F.lit(0).alias("edits"))
    unsettled = forms.join(standing.select("key"), "key", "left_anti").where(~F.col("read").rlike(r"^[\d.,/:-]+$"))
    unsettled = unsettled.withColumn("glyphs", skeleton(F.col("read")))
    mates = (
        unsettled.join(known.withColumn("glyphs", skeleton(F.col("form"))), "glyphs").withColumn("edits", F.levenshtein("read", "form"))
        .where(F.col("edits") > 0).select("key", "read", "form", "form_n", "edits")
    )
    figure = F.translate(F.col("read"), *FIGURES)
    numbers = unsettled.where(F.col("read").rlike(r"\d") & F.col("read").rlike(r"^[\doilsbgzq|.,/]+$") & F.col("read").rlike(r"\p{L}|\|")).select(
        "key", "read", figure.alias("form"), F.lit(0).cast("long").alias("form_n"), F.levenshtein("read", figure).alias("edits")
    )
    both = words.join(standing.unionByName(mates).unionByName(numbers), "key", "left")
    wanted = both.where(F.col("broken") | (F.col("edits") > 0))
    role = F.when(F.col("form").rlike(r"^\d"), "#").otherwise(F.col("form"))
    near = (
        wanted.withColumn("role", role)
        .join(pairs.select(F.col("a").alias("before"), F.col("b").alias("role"), F.col("n").alias("n_before")), ["before", "role"], "left")
        .join(pairs.select(F.col("a").alias("role"), F.col("b").alias("after"), F.col("n").alias("n_after")), ["role", "after"], "left")
    )
    support = F.log1p(F.coalesce("n_before", F.lit(0))) + F.log1p(F.coalesce("n_after", F.lit(0)))
    best = Window.partitionBy("row_id", "line_no", "pos").orderBy((support - 2.5 * F.col("edits")).desc(), F.col("form_n").desc(), "form")
    joined = F.concat("left", F.coalesce("right", F.lit("")))
    return (
        near.withColumn("nth", F.row_number().over(best)).where("nth = 1")
        .select("row_id", "line_no", "pos", F.coalesce("form", joined).alias("fix")).where("fix <> ''")
    )


def _scanned(df: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Lines of the scanned pages with their furniture told, and the counts of clean pages; both read more than once."""
    source = F.xxhash64(F.coalesce(F.col(source_col).cast("string"), F.lit(""))) if source_col in df.columns else F.lit(0).cast("long")
    rows = df.select(F.col(id_col).alias("row_id"), source.alias("source"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    counted = (
        rows.select("text").mapInArrow(_clean_counts, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    )
    counts = cut_lineage(counted.where((F.col("a").isNotNull() | (F.col("n") >= 2)) & (F.col("b") != "")))
    total = counts.where("a IS NULL").agg((F.sum("n") * KNOWN_RATE).alias("least"))
    counts = counts.crossJoin(F.broadcast(total)).where(
        F.col("a").isNotNull() | (F.col("n") >= F.greatest(F.col("least"), F.lit(float(KNOWN_LEAST))))
    ).drop("least")
    kind = df.schema[id_col].dataType.simpleString()
    scanned = rows.withColumn("page", F.xxhash64("text")).mapInArrow(_scanned_lines, f"row_id {kind}, source long, page long, line_no long, line string")
    lines = cut_lineage(with_furniture(cut_lineage(scanned)))
    return lines, counts


def scan_repairs(df: DataFrame, id_col: str = "ingest_id", text_col: str = "text", source_col: str = "source_doc_id") -> DataFrame:
    """``row_id, line_no, fix`` of everything to be mended on scanned pages.

    ``fix`` is the whole word in lower case for a broken or misread word, on the line where it starts, and empty
    for a line of page furniture. Null and blank texts and pages without the layout of a scan give no rows;
    repeated rows give theirs under their own id. What a word must read is known from all pages that are not
    scanned.
    """
    lines, counts = _scanned(df, id_col, text_col, source_col)
    furniture = lines.where("furniture").select("row_id", "line_no", F.lit("").alias("fix"))
    return repaired_words(flowing_words(lines), counts).drop("pos").unionByName(furniture).distinct()


def reflowed(df: DataFrame, id_col: str = "ingest_id", text_col: str = "text", source_col: str = "source_doc_id") -> DataFrame:
    """``row_id, text``: the body of each scanned page as continuous paragraphs, without furniture.

    Broken words are whole and misread ones mended, in the case and with the punctuation they had; blank lines
    part paragraphs. Pages that are not scanned give no row.
    """
    lines, counts = _scanned(df, id_col, text_col, source_col)
    words = flowing_words(lines)
    fixes = repaired_words(words, counts)
    core = F.regexp_replace("raw", r"^[^\p{L}\p{N}]+", "")
    cased = (
        F.when((F.upper(core) == core) & (F.lower(core) != core) & (F.length("left") > 1), F.upper("fix"))
        .when(core.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring("fix", 1, 1)), F.expr("substring(fix, 2)"))).otherwise(F.col("fix"))
    )
    before = F.regexp_extract("raw", r"^[^\p{L}\p{N}]*", 0)
    behind = F.regexp_extract(F.coalesce("raw_right", "raw"), r"[^\p{L}\p{N}]*$", 0)
    token = F.when(F.col("fix").isNull(), F.col("raw")).otherwise(F.concat(before, cased, behind))
    read = words.join(fixes, ["row_id", "line_no", "pos"], "left").select("row_id", "para", "line_no", "pos", token.alias("token"))
    ordered = lambda *by: F.array_sort(F.collect_list(F.struct(*by)))
    paragraphs = read.groupBy("row_id", "para").agg(F.array_join(F.transform(ordered("line_no", "pos", "token"), lambda x: x["token"]), " ").alias("body"))
    return paragraphs.groupBy("row_id").agg(F.array_join(F.transform(ordered("para", "body"), lambda x: x["body"]), "\n\n").alias("text"))
