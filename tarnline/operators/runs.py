"""Running sums, neighbours and percentiles over groups of any size.

A window over a group puts the group into one task. Here a group is cut into blocks of its order column; a small
window runs over the blocks' totals, and the full rows only meet inside their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a block in units of the order column.
BLOCK = 1024


def running_sum(df: DataFrame, group: str, order: str, value: str, into: str, width: int = BLOCK) -> DataFrame:
    """``df`` with the running sum of ``value`` up to and with each row; ``order`` is an integer, unique in its group."""
    cut = df.withColumn("_block", F.floor(F.col(order) / width))
    totals = cut.groupBy(group, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(group, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(base, [group, "_block"]).withColumn(into, F.sum(value).over(inside) + F.col("_base")).drop("_block", "_base")


def previous(df: DataFrame, group: str, order: list[str], value: str, into: str, width: int = BLOCK) -> DataFrame:
    """``df`` with the value of the row before in ``order``, whose first column is an integer."""
    cut = df.withColumn("_block", F.floor(F.col(order[0]) / width))
    last = cut.groupBy(group, "_block").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    over = Window.partitionBy(group).orderBy("_block")
    base = last.select(group, "_block", F.lag("_last").over(over)["v"].alias("_base"))
    inside = Window.partitionBy(group, "_block").orderBy(*order)
    first: Column = F.row_number().over(inside) == 1
    return (
        cut.join(base, [group, "_block"]).withColumn(into, F.when(first, F.col("_base")).otherwise(F.lag(value).over(inside)))
        .drop("_block", "_base")
    )


def following(df: DataFrame, group: str, order: list[str], value: str, into: str, width: int = BLOCK) -> DataFrame:
    """``df`` with the value of the row after in ``order``, whose first column is an integer."""
    cut = df.withColumn("_block", F.floor(F.col(order[0]) / width))
    first = cut.groupBy(group, "_block").agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_first"))
    over = Window.partitionBy(group).orderBy("_block")
    base = first.select(F.col(group).alias("_group"), F.col("_block").alias("_at"), F.lead("_first").over(over)["v"].alias("_base"))
    inside = Window.partitionBy(group, "_block").orderBy(*order)
    last: Column = F.lead(F.lit(1)).over(inside).isNull()
    return (
        cut.join(base, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_at")))
        .withColumn(into, F.when(last, F.col("_base")).otherwise(F.lead(value).over(inside))).drop("_block", "_base", "_group", "_at")
    )


#: Rows of a group up to which all its values are ranked for a percentile; in larger ones only those near the sought rank.
RANKED = 10_000
_ACCURACY, _MARGIN = 20_000, 3e-4


def percentiles(df: DataFrame, group: str, value: str, rates: dict[str, float]) -> DataFrame:
    """``group`` and an exact, linearly interpolated percentile of ``value`` for each named rate; nulls do not count.

    No group is ranked whole: a mergeable sketch brackets the sought rank from below and above within a known error,
    rows below the bracket are counted, and only the values inside, counted by value first, are ranked.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    parts = None
    for name, rate in rates.items():
        low, high = (F.percentile_approx("_v", F.lit(min(1.0, max(0.0, rate + m))), F.lit(_ACCURACY)) for m in (-_MARGIN, _MARGIN))
        small = F.count(F.lit(1)) <= RANKED
        bracket = rows.groupBy("_g").agg(
            F.count(F.lit(1)).alias("_n"), F.when(small, F.min("_v")).otherwise(low).alias("_low"), F.when(small, F.max("_v")).otherwise(high).alias("_high")
        ).select(F.col("_g").alias("_b"), "_n", "_low", "_high")
        placed = rows.join(bracket, F.col("_g").eqNullSafe(F.col("_b"))).where(F.col("_v") <= F.col("_high"))
        near = placed.groupBy("_g", "_n", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
        upto = F.sum("_k").over(Window.partitionBy("_g").orderBy(F.asc_nulls_first("_v")))
        rank = (F.col("_n") - 1) * F.lit(rate)
        ranked = near.withColumn("_upto", upto).where("_v IS NOT NULL")
        at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
        found = ranked.groupBy("_g", "_n").agg(at(F.floor(rank)).alias("_a"), at(F.ceil(rank)).alias("_c"))
        one = found.select("_g", (F.col("_a") + (F.col("_c") - F.col("_a")) * (rank - F.floor(rank))).alias(name))
        parts = one if parts is None else parts.join(one.withColumnRenamed("_g", "_o"), F.col("_g").eqNullSafe(F.col("_o"))).drop("_o")
    return parts.withColumnRenamed("_g", group)
