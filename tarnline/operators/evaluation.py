"""Aggregates over scored rows in long form: metrics, health, deltas, gates, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric(value: Column) -> Column:
    """The value, or null where it is null or NaN; ``avg`` would return NaN for a single NaN."""
    return F.when(value.isNotNull() & ~F.isnan(value), value)


def health(scores: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``n, n_numeric, n_missing, mean`` per key; the mean of nothing is null."""
    number = numeric(F.col(value))
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(number).alias("n_numeric"), (F.count(F.lit(1)) - F.count(number)).alias("n_missing"), F.avg(number).alias("mean")
    )


def paired(scores: DataFrame, keys: list[str], arm: str, base: str, now: str, value: str = "value") -> DataFrame:
    """``keys, base, now, delta``: means of two arms of a run side by side, where both have a number.

    One pass over the scores: the arms are conditional aggregates of one group, not a join of two.
    """
    number = numeric(F.col(value))
    means = scores.where(F.col(arm).isin(base, now)).groupBy(*keys).agg(
        F.avg(F.when(F.col(arm) == base, number)).alias("base"), F.avg(F.when(F.col(arm) == now, number)).alias("now")
    )
    return means.where(F.col("base").isNotNull() & F.col("now").isNotNull()).withColumn("delta", F.col("now") - F.col("base"))


def gains_and_losses(pairs: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Counts of deltas at or beyond the threshold on either side."""
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.round("delta", 9) >= threshold).alias("n_gains"), F.count_if(F.round("delta", 9) <= -threshold).alias("n_losses")
    )


def rollup_means(scores: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Means by key and over all keys in one pass; the total has null keys."""
    return scores.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(numeric(F.col(value))).alias("mean"))


def first_match(rules: DataFrame, rows: DataFrame, rule_id: str, pattern: str, row_id: str, text: str) -> DataFrame:
    """``rule_id, row_id``: for each rule the first row whose text contains its words in any case; null without one.

    Rules are joined by their first word, so that rules meet only the rows that hold it, and tested there.
    """
    lead = lambda c: F.filter(F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    keyed = rules.select(rule_id, F.lower(F.col(pattern)).alias("_p"), lead(pattern)[0].alias("_w"))
    held = rows.select(row_id, F.lower(F.col(text)).alias("_t"), F.explode(F.array_distinct(lead(text))).alias("_w"))
    hits = keyed.join(held, "_w").where(F.contains("_t", "_p")).groupBy(rule_id).agg(F.min(row_id).alias(row_id))
    return rules.select(rule_id).join(hits, rule_id, "left")
