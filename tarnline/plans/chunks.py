"""Chunk-level queries over the pages in ingest and the texts in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import entry_name as name_of
from ..functions.text import is_blank, sentences, squeezed, stripped
from ..operators.chunking import capped, entries, headed, page_spans as spans_of, records, sections, semantic_build as built, sentence_windows as windows_of, split_rows, start_offsets, start_pages
from ..operators.runs import previous, running_sum
from ..sources.tables import latest_chunks, table
from .registry import query

#: Characters from which a chunk counts as oversized.
LIMIT = 1500

_WS = r"[\s\p{Z}\x{85}]"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ingest", "ingest_id", "text").where("text IS NOT NULL")


@query(rf"SELECT ingest_id, length(regexp_replace(text, '{_WS}+', '', 'g')) AS n FROM ingest WHERE text IS NOT NULL")
def whitespace_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("ingest_id", F.length(squeezed(F.col("text"))).cast("long").alias("n"))


@query(rf"SELECT coalesce(source_doc_id, '?') AS source_doc_id, count(*) FILTER (text IS NOT NULL AND regexp_matches(text, '[^\s\p{{Z}}\x{{85}}]')) AS n_kept, count(*) AS n FROM ingest GROUP BY 1")
def nonblank_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ingest", "source_doc_id", "text")
    return rows.groupBy(F.coalesce("source_doc_id", F.lit("?")).alias("source_doc_id")).agg(F.count_if(~is_blank(F.col("text"))).alias("n_kept"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT ingest_id, length(text) AS n_chars, CAST(ceil(length(text) / {LIMIT}.0) AS BIGINT) AS n_pieces FROM ingest WHERE length(text) > {LIMIT}")
def oversized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    return _texts(spark, sf_dir).where(n > LIMIT).select("ingest_id", n.alias("n_chars"), F.ceil(n / LIMIT).alias("n_pieces"))


@query(r"SELECT ingest_id, len(regexp_extract_all(text, '(?m)^\d+\. ')) AS n_headers FROM ingest WHERE len(regexp_extract_all(text, '(?m)^\d+\. ')) >= 2")
def multi_record_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold more than one numbered entry."""
    counted = _texts(spark, sf_dir).withColumn("n_headers", F.regexp_count("text", F.lit(r"(?m)^\d+\. ")).cast("long"))
    return counted.where("n_headers >= 2").select("ingest_id", "n_headers")


@query(r"""WITH l AS (SELECT ingest_id, i, parts[i] AS line FROM (SELECT ingest_id, string_split(text, chr(10)) AS parts FROM ingest WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS t(i)),
    n AS (SELECT ingest_id, i, line, sum(CASE WHEN regexp_matches(line, '^\d+\. ') THEN 1 ELSE 0 END) OVER (PARTITION BY ingest_id ORDER BY i) AS record_no FROM l)
    SELECT ingest_id, CAST(record_no AS BIGINT) AS record_no, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM n GROUP BY 1, 2""")
def structure_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into records at numbered lines."""
    cut = records(_texts(spark, sf_dir), "ingest_id", "text", r"\d+\. ")
    return cut.select("ingest_id", "record_no", F.md5("record").alias("digest"))


@query(r"""WITH p AS (SELECT ingest_id, list_filter(string_split(regexp_replace(text, '(Chapter\s+\d+)', chr(31) || '\1', 'g'), chr(31)), lambda x: regexp_matches(x, '\S')) AS parts FROM ingest WHERE text IS NOT NULL)
    SELECT ingest_id, i - 1 AS section_no, md5(parts[i]) AS digest FROM p, unnest(range(1, len(parts) + 1)) AS t(i)""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sections(_texts(spark, sf_dir), "ingest_id", "text", r"Chapter\s+\d+")
    return cut.select("ingest_id", "section_no", F.md5("section").alias("digest"))


_SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: regexp_matches(x, '\S'))"


@query(f"SELECT doc_id, len({_SENTENCES}) AS n_sentences FROM documents WHERE text IS NOT NULL")
def sentence_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.size(sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(f"""WITH s AS (SELECT ingest_id, i - 1 AS n, parts[i] AS sentence FROM (SELECT ingest_id, {_SENTENCES} AS parts FROM ingest WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS t(i))
    SELECT ingest_id, n, md5(concat_ws(' ', lag(sentence) OVER w, sentence, lead(sentence) OVER w)) AS digest FROM s WINDOW w AS (PARTITION BY ingest_id ORDER BY n)""")
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows_of(_texts(spark, sf_dir), "ingest_id", "text").select("ingest_id", "n", F.md5("window").alias("digest"))


_PAGES = rf"""WITH sized AS (SELECT source_doc_id, page, CAST(sum(length(regexp_replace(coalesce(text, ''), '{_WS}+', '', 'g'))) AS BIGINT) AS n
    FROM ingest WHERE source_doc_id IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2),
    spans AS (SELECT source_doc_id, page, CAST(sum(n) OVER w - n AS BIGINT) AS start_at, CAST(sum(n) OVER w AS BIGINT) AS end_at FROM sized WINDOW w AS (PARTITION BY source_doc_id ORDER BY page))
"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "ingest", "source_doc_id", "page", "text").where("source_doc_id IS NOT NULL AND page IS NOT NULL"))


@query(_PAGES + "SELECT * FROM spans")
def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)


_STEP = 4000


@query(_PAGES + f""", total AS (SELECT source_doc_id, max(end_at) AS total FROM spans GROUP BY 1),
    off AS (SELECT source_doc_id, o AS at_char FROM total, unnest(range(0, total, {_STEP})) AS t(o))
    SELECT off.source_doc_id, at_char, min(page) AS page FROM off JOIN spans s ON off.source_doc_id = s.source_doc_id AND at_char >= start_at AND at_char < end_at GROUP BY 1, 2""")
def page_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page on which every {_STEP}th character of a document stands.

    The range join is turned into one by equality: each page takes the steps that fall into its own span.
    """
    first = F.ceil(F.col("start_at") / _STEP)
    last = F.floor((F.col("end_at") - 1) / _STEP)
    held = _spans(spark, sf_dir).where((F.col("end_at") > F.col("start_at")) & (last >= first))
    steps = held.select("source_doc_id", F.explode(F.sequence(first, last)).alias("step"), "page")
    return steps.select("source_doc_id", (F.col("step") * _STEP).alias("at_char"), "page")


_PIECES = _PAGES + rf""", pieces AS (SELECT source_doc_id, page AS own, ingest_id, CAST(length(regexp_replace(coalesce(text, ''), '{_WS}+', '', 'g')) AS BIGINT) AS n
        FROM ingest WHERE source_doc_id IS NOT NULL AND page IS NOT NULL),
    placed AS (SELECT source_doc_id, own, ingest_id, row_number() OVER w - 1 AS chunk_index, CAST(sum(n) OVER w - n AS BIGINT) AS at_char FROM pieces WINDOW w AS (PARTITION BY source_doc_id ORDER BY own, ingest_id))
"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each document in the order of their pages, with their number and start among its characters."""
    rows = table(spark, sf_dir, "ingest", "source_doc_id", "page", "ingest_id", "text").where("source_doc_id IS NOT NULL AND page IS NOT NULL")
    sized = rows.select("source_doc_id", F.col("page").alias("own"), "ingest_id", F.length(squeezed(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    totals = sized.groupBy("source_doc_id", "own").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    upto = running_sum(running_sum(totals, "source_doc_id", "own", "n", "upto_n"), "source_doc_id", "own", "k", "upto_k")
    base = upto.select("source_doc_id", "own", (F.col("upto_n") - F.col("n")).alias("base_n"), (F.col("upto_k") - F.col("k")).alias("base_k"))
    page = Window.partitionBy("source_doc_id", "own").orderBy("ingest_id")
    before = F.coalesce(F.sum("n").over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    inside = sized.withColumns({"place": F.row_number().over(page).cast("long") - 1, "before": before})
    return inside.join(base, ["source_doc_id", "own"]).select("source_doc_id", "own", "ingest_id", (F.col("base_k") + F.col("place")).alias("chunk_index"), (F.col("base_n") + F.col("before")).alias("at_char"))


@query(_PIECES + "SELECT source_doc_id, ingest_id, chunk_index FROM placed")
def chunk_index_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contiguous index of each row in its document."""
    return _placed(spark, sf_dir).select("source_doc_id", "ingest_id", "chunk_index")


@query(_PIECES + """SELECT p.source_doc_id, ingest_id, at_char, coalesce(min(s.page), any_value(l.page)) AS page FROM placed p
    LEFT JOIN spans s ON s.source_doc_id = p.source_doc_id AND at_char >= start_at AND at_char < end_at
    JOIN (SELECT source_doc_id, max(page) AS page FROM spans GROUP BY 1) l ON l.source_doc_id = p.source_doc_id GROUP BY 1, 2, 3""")
def chunk_start_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page on which each row begins by its offset; beyond the last character it is the document's last page."""
    return start_pages(_placed(spark, sf_dir).drop("own"), _spans(spark, sf_dir), "source_doc_id", "at_char").select("source_doc_id", "ingest_id", "at_char", "page")


@query(_PIECES + """, paged AS (SELECT p.source_doc_id, ingest_id, coalesce(min(s.page), any_value(l.page)) AS page, any_value(l.page) AS last FROM placed p
        LEFT JOIN spans s ON s.source_doc_id = p.source_doc_id AND at_char >= start_at AND at_char < end_at
        JOIN (SELECT source_doc_id, max(page) AS page FROM spans GROUP BY 1) l ON l.source_doc_id = p.source_doc_id GROUP BY 1, 2, at_char)
    SELECT source_doc_id, count(*) AS n_chunks, count(*) FILTER (page BETWEEN 1 AND last) = count(*) AS in_range FROM paged GROUP BY 1""")
def start_pages_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every chunk of a document begins on one of its pages."""
    spans = _spans(spark, sf_dir)
    last = spans.groupBy("source_doc_id").agg(F.max("page").alias("last"))
    paged = start_pages(_placed(spark, sf_dir).drop("own"), spans, "source_doc_id", "at_char").join(last, "source_doc_id")
    return paged.groupBy("source_doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.bool_and(F.col("page").between(1, F.col("last"))).alias("in_range"))


@query()
def semantic_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ingest from its pages to chunks with ids, by the sense of its sentences.

    A page is made of the rows last ingested under its ids, in their order.
    """
    rows = latest_chunks(spark, sf_dir, "namespace", "id", "source_doc_id", "page", "chunk_index", "text").where("source_doc_id IS NOT NULL AND page IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "id", F.coalesce("text", F.lit("")).alias("text"))))  # the rows of one page
    pages = rows.groupBy("namespace", "source_doc_id", "page").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
    named = pages.select(F.concat_ws("/", "namespace", "source_doc_id").alias("source_doc_id"), "page", "text")
    return built(named)


@query()
def entry_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into entries at the line that holds the marker, or the line before where the marker opens it."""
    return entries(_texts(spark, sf_dir), "ingest_id", "text", "Disclaimer:")


@query()
def headed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into sections at their heads in any case; those without a head go through the splitter for prose."""
    return headed(_texts(spark, sf_dir), "ingest_id", "text", r"chapter\s+\d+")


@query("""WITH p AS (SELECT source_doc_id, ingest_id, page, lag(page) OVER (PARTITION BY source_doc_id ORDER BY chunk_index, ingest_id) AS before
    FROM ingest WHERE source_doc_id IS NOT NULL AND page IS NOT NULL)
    SELECT source_doc_id, bool_and(page >= 1) AS in_range, count(*) FILTER (page < before) AS n_backward FROM p GROUP BY 1""")
def page_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ingest", "source_doc_id", "page", "chunk_index", "ingest_id").where("source_doc_id IS NOT NULL AND page IS NOT NULL")
    return previous(rows, "source_doc_id", ["chunk_index", "ingest_id"], "page", "before").groupBy("source_doc_id").agg(
        F.bool_and(F.col("page") >= 1).alias("in_range"), F.count_if(F.col("page") < F.col("before")).alias("n_backward")
    )


@query(rf"""WITH l AS (SELECT doc_id, i - 1 AS line_no, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS t(i))
    SELECT doc_id, line_no, CAST(coalesce(sum(length(regexp_replace(line, '{_WS}+', '', 'g'))) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM l""")
def chunk_start_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line of a document starts, counted without white space."""
    lines = start_offsets(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", F.split("text", "\n"))
    return lines.select("doc_id", F.col("piece_no").alias("line_no"), "offset")


@query("""WITH s AS (SELECT source_doc_id, length(text) AS n, row_number() OVER (PARTITION BY source_doc_id ORDER BY length(text)) - 1 AS rn, count(*) OVER (PARTITION BY source_doc_id) AS total
    FROM ingest WHERE text IS NOT NULL AND source_doc_id IS NOT NULL)
    SELECT source_doc_id, round(avg(n), 6) AS mean, median(n) AS median, max(CASE WHEN rn = least(total - 1, CAST(floor(0.95 * total) AS BIGINT)) THEN n END) AS p95, max(n) AS longest FROM s GROUP BY 1""")
def chunk_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths per source; the 95th percentile is the element at that place of the sorted lengths.

    Rows are first counted by length, so a source is ranked over its distinct lengths and not over its rows.
    """
    rows = table(spark, sf_dir, "ingest", "source_doc_id", "text").where("text IS NOT NULL AND source_doc_id IS NOT NULL")
    counted = rows.groupBy("source_doc_id", F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("k"))
    run = Window.partitionBy("source_doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source_doc_id")
    placed = counted.withColumns({"upto": F.sum("k").over(run), "total": F.sum("k").over(whole)})
    at = F.least(F.col("total") - 1, F.floor(F.lit(0.95) * F.col("total")))
    return placed.groupBy("source_doc_id").agg(
        F.round(F.sum(F.col("n") * F.col("k")) / F.sum("k"), 6).alias("mean"), F.percentile("n", F.lit(0.5), F.col("k")).alias("median"),
        F.max(F.when((F.col("upto") > at) & (F.col("upto") - F.col("k") <= at), F.col("n"))).cast("long").alias("p95"), F.max("n").cast("long").alias("longest"),
    )


@query(r"""SELECT source_doc_id, max_by(ingest_id, (len(regexp_extract_all(text, '\w+')), -ingest_id)) AS ingest_id, max(len(regexp_extract_all(text, '\w+'))) AS n_tokens
    FROM ingest WHERE text IS NOT NULL AND source_doc_id IS NOT NULL GROUP BY 1""")
def largest_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ingest", "source_doc_id", "ingest_id", "text").where("text IS NOT NULL AND source_doc_id IS NOT NULL")
    sized = rows.select("source_doc_id", "ingest_id", F.regexp_count("text", F.lit(r"\w+")).cast("long").alias("n"))
    best = F.max(F.struct("n", -F.col("ingest_id")))
    return sized.groupBy("source_doc_id").agg(best.alias("b")).select("source_doc_id", (-F.col("b.col2")).alias("ingest_id"), F.col("b.n").alias("n_tokens"))


@query(r"""SELECT source_doc_id, count(*) AS n_chunks, CAST(sum(len(regexp_extract_all(text, '\w+'))) AS BIGINT) AS n_tokens, CAST(ceil(count(*) / 32.0) AS BIGINT) AS n_requests
    FROM ingest WHERE text IS NOT NULL AND source_doc_id IS NOT NULL GROUP BY 1""")
def embed_request_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, tokens and requests of 32 chunks that embedding each source takes."""
    rows = table(spark, sf_dir, "ingest", "source_doc_id", "text").where("text IS NOT NULL AND source_doc_id IS NOT NULL")
    return rows.groupBy("source_doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.regexp_count("text", F.lit(r"\w+")).cast("long")).alias("n_tokens"), F.ceil(F.count(F.lit(1)) / 32).alias("n_requests")
    )


@query(rf"""SELECT m.doc_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_chars, 0) AS n_chars FROM manifest m LEFT JOIN (
    SELECT source_doc_id, count(*) AS n_chunks, CAST(sum(length(regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g'))) AS BIGINT) AS n_chars FROM ingest GROUP BY 1) i ON m.doc_id = i.source_doc_id""")
def chunks_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and characters of every listed document, also of those without any."""
    counted = table(spark, sf_dir, "ingest", "source_doc_id", "text").groupBy(F.col("source_doc_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length(stripped(F.coalesce("text", F.lit("")))).cast("long")).alias("n_chars")
    )
    zero = F.lit(0).cast("long")
    return table(spark, sf_dir, "manifest", "doc_id").join(counted, "doc_id", "left").select("doc_id", F.coalesce("n_chunks", zero).alias("n_chunks"), F.coalesce("n_chars", zero).alias("n_chars"))


@query(r"""SELECT m.doc_id FROM manifest m LEFT JOIN ingest i ON i.source_doc_id = m.doc_id
    GROUP BY 1 HAVING count(*) FILTER (i.text IS NOT NULL AND regexp_matches(i.text, '[^\s\p{Z}\x{85}]')) = 0""")
def zero_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed documents of which no page holds any text."""
    said = table(spark, sf_dir, "ingest", "source_doc_id", "text").where(~is_blank(F.col("text"))).select(F.col("source_doc_id").alias("doc_id")).distinct()
    return table(spark, sf_dir, "manifest", "doc_id").join(said, "doc_id", "left_anti")


@query(r"SELECT ingest_id FROM ingest WHERE text IS NULL OR NOT regexp_matches(text, '[^\s\p{Z}\x{85}]')")
def zero_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ingest", "ingest_id", "text").where(is_blank(F.col("text"))).select("ingest_id")


@query()
def recursive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", 500, 50)


@query()
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ingest through the splitter of 500 characters and 50 overlap; no piece crosses a row."""
    return split_rows(table(spark, sf_dir, "ingest", "ingest_id", "text"), "ingest_id", "text", 500, 50)


@query()
def cap_subsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capped(_texts(spark, sf_dir), "ingest_id", "text", LIMIT)


@query()
def prose_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(_texts(spark, sf_dir), "ingest_id", "text", 1500, 0)


@query()
def page_text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC form without soft hyphens, of texts beyond ASCII; the others are their own form."""
    from ..functions.unicode import nfkc

    plain = ~F.col("text").rlike(r"[^\x00-\x7F]")
    rows = _texts(spark, sf_dir)
    return rows.where(plain).unionByName(rows.where(~plain).withColumn("text", nfkc(F.col("text"))))


_NAMED = r"""WITH l AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS t(i)),
    n AS (SELECT doc_id, i - 1 AS line_no, array_to_string(list_filter(regexp_split_to_array(split_part(line, ' – ', 1), '[\s\p{Z}]+'), lambda x: x <> ''), ' ') AS name FROM l WHERE contains(line, ' – '))
"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    named = lines.withColumn("name", name_of(F.col("line"), " – ")).where(F.col("name").isNotNull())
    return named.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "name")


@query(_NAMED + "SELECT * FROM n")
def entry_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of entries: what stands before the dash of a line."""
    return _named(spark, sf_dir)


@query(_NAMED + "SELECT doc_id, count(*) AS n_orphans FROM n WHERE name = '' OR regexp_matches(name, '[0-9]') GROUP BY 1")
def orphaned_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without a name, or with a figure for one."""
    odd = (F.col("name") == "") | F.col("name").rlike("[0-9]")
    return _named(spark, sf_dir).where(odd).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_orphans"))
