"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeated_lines import repeated_lines

    rows = read_table(spark, sf_dir, "ingest", "ingest_id", "source_doc_id", "text")
    return repeated_lines(rows).withColumnRenamed("row_id", "ingest_id")


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field, row_id, question, text``: each question with its reference, each answer with its question."""
    questions = read_table(spark, sf_dir, "dataset", "eval_id", "question", "reference")
    answers = read_table(spark, sf_dir, "askresponse", "response_id", "eval_id", "answer").where(F.col("eval_id").isNotNull())
    own = questions.select(F.lit("reference").alias("field"), F.col("eval_id").alias("row_id"), "question", F.col("reference").alias("text"))
    given = answers.join(questions.select("eval_id", "question"), "eval_id", "left").select(
        F.lit("answer").alias("field"), F.col("response_id").alias("row_id"), "question", F.col("answer").alias("text")
    )
    return own.unionByName(given)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pairs import broken_pairs

    return broken_pairs(all_pairs(spark, sf_dir), read_table(spark, sf_dir, "documents", "text", "lang"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .confusables import changed_records

    pages = changed_records(read_table(spark, sf_dir, "ingest", "ingest_id", "text"), "ingest_id", "text")
    tokens = read_table(spark, sf_dir, "verify_eval_tokens", "cand_id", "key_value_token")
    return pages.unionByName(changed_records(tokens, "cand_id", "key_value_token"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts, and of tokens, that look the same."""
    from .confusables import same_looking

    pages = same_looking(read_table(spark, sf_dir, "ingest", "ingest_id", "text"), "ingest_id", "text")
    return pages.unionByName(same_looking(read_table(spark, sf_dir, "verify_eval_tokens", "cand_id", "key_value_token"), "cand_id", "key_value_token"))


def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each record."""
    from .confusables import members

    pages = members(read_table(spark, sf_dir, "ingest", "ingest_id", "text"), "ingest_id", "text")
    return pages.unionByName(members(read_table(spark, sf_dir, "verify_eval_tokens", "cand_id", "key_value_token"), "cand_id", "key_value_token")).drop("original")


def p3_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .confusables import consistent_text

    return consistent_text(read_table(spark, sf_dir, "ingest", "ingest_id", "text"), "text")


def p3_tokens_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .confusables import tokens_on_pages

    return tokens_on_pages(read_table(spark, sf_dir, "verify_eval_tokens"), read_table(spark, sf_dir, "ingest"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import not_prose

    return not_prose(read_table(spark, sf_dir, "ingest", "ingest_id", "source_doc_id", "text"))


def p4_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(read_table(spark, sf_dir, "ingest", "ingest_id", "source_doc_id", "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scans import scan_repairs

    return scan_repairs(read_table(spark, sf_dir, "ingest", "ingest_id", "source_doc_id", "text")).withColumnRenamed("row_id", "ingest_id")


def p5_reflowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scans import reflowed

    return reflowed(read_table(spark, sf_dir, "ingest", "ingest_id", "source_doc_id", "text")).withColumnRenamed("row_id", "ingest_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_ids

    return token_ids(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .leaks import leaked_items

    found = leaked_items(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "item_id")


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in each document the passage of the item lies, and its longest exact phrase."""
    from .leaks import leaked_items

    return leaked_items(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .abuse import abuse_scores

    return abuse_scores(read_table(spark, sf_dir, "documents", "doc_id", "source", "text")).where("abusive").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .abuse import abuse_scores

    return abuse_scores(read_table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .abuse import abuse_rates, abuse_scores

    return abuse_rates(abuse_scores(read_table(spark, sf_dir, "documents", "doc_id", "source", "text")))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeated_lines import repeated_lines, without_lines

    rows = read_table(spark, sf_dir, "ingest", "ingest_id", "source_doc_id", "text")
    return without_lines(rows, repeated_lines(rows)).select("ingest_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_clean, p2_found, p3_found, p3_groups, p3_members, p3_consistent, p3_tokens_on_pages, p4_found, p4_statistics, p5_found, p5_reflowed, p6_ids, p7_found, p7_passages, p8_found, p8_scores, p8_rates)
}

ORACLES: dict[str, str] = {
    "p1_found": r"""
        WITH lines AS (
            SELECT ingest_id, source_doc_id, i AS line_no,
                   lower(regexp_replace(parts[i], '[\s\p{Z}\p{Nd}\x{85}\x1c-\x1f\x0b]+', '', 'g')) AS k
            FROM (SELECT ingest_id, source_doc_id, string_split(text, chr(10)) AS parts FROM ingest
                  WHERE text IS NOT NULL AND source_doc_id IS NOT NULL), unnest(range(1, len(parts) + 1)) AS t(i)),
        totals AS (SELECT source_doc_id, count(*) AS total FROM ingest WHERE source_doc_id IS NOT NULL GROUP BY 1),
        cases AS (
            SELECT l.source_doc_id, k FROM lines l JOIN totals t USING (source_doc_id)
            WHERE regexp_matches(k, '\p{L}')
            GROUP BY l.source_doc_id, k, total
            HAVING count(DISTINCT ingest_id) >= greatest(5, total * 0.05))
        SELECT ingest_id, line_no FROM lines JOIN cases USING (source_doc_id, k)""",
    "p1_clean": r"""
        WITH lines AS (
            SELECT ingest_id, source_doc_id, i AS line_no, parts[i] AS line,
                   lower(regexp_replace(parts[i], '[\s\p{Z}\p{Nd}\x{85}\x1c-\x1f\x0b]+', '', 'g')) AS k
            FROM (SELECT ingest_id, source_doc_id, string_split(text, chr(10)) AS parts FROM ingest
                  WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS t(i)),
        totals AS (SELECT source_doc_id, count(*) AS total FROM ingest WHERE source_doc_id IS NOT NULL GROUP BY 1),
        cases AS (
            SELECT l.source_doc_id, k, true AS hit FROM lines l JOIN totals t USING (source_doc_id)
            WHERE regexp_matches(k, '\p{L}')
            GROUP BY l.source_doc_id, k, total
            HAVING count(DISTINCT ingest_id) >= greatest(5, total * 0.05)),
        kept AS (SELECT l.ingest_id, string_agg(line, chr(10) ORDER BY line_no) AS text
                 FROM lines l LEFT JOIN cases c ON l.source_doc_id = c.source_doc_id AND l.k = c.k WHERE c.hit IS NULL GROUP BY 1)
        SELECT i.ingest_id, CASE WHEN i.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
        FROM ingest i LEFT JOIN kept USING (ingest_id)""",
}
