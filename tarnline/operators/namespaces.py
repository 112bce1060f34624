"""The namespaced chunk table: upsert, copy, rebuild and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(held: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows after an id-keyed overwrite: of each key the row that is last by ``order``, the incoming one of equals.

    Only keys and orders are aggregated, in a hash table and partly before the shuffle, so a key with many rows is no
    hot group; the winning rows then move once. A side that repeats a row under one key and order keeps one of them,
    by its digest and, if that is equal too, by ``dropDuplicates``.
    """
    sides = held.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    rows = sides.withColumn("_rank", F.struct(F.col(order).alias("o"), "_side", F.xxhash64(*held.columns).alias("h"))).drop("_side")
    best = rows.groupBy(*keys).agg(F.max("_rank").alias("_best"))
    same = [rows[k].eqNullSafe(best[k]) for k in keys]
    won = rows.join(best, [*same, rows["_rank"] == best["_best"]], "left_semi").drop("_rank")
    return won.dropDuplicates([*keys])


def write_namespaces(df: DataFrame, path: str, replace: bool = True, by: tuple[str, ...] = ("namespace",)) -> None:
    """Writes the table partitioned by namespace, or by the columns ``by``; only the partitions in ``df`` are replaced,
    or none may exist."""
    writer = df.write.partitionBy(*by)
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("errorifexists").parquet(path)


def copied(df: DataFrame, source: str, target: str, skip: Column) -> DataFrame:
    """Rows of namespace ``source`` under the name ``target``, without those where ``skip`` holds."""
    return df.where((F.col("namespace") == source) & ~F.coalesce(skip, F.lit(False))).withColumn("namespace", F.lit(target))


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, issue``: keys that one side lacks, or whose rows differ; null equals null."""
    left = a.select(*keys, F.struct(*columns).alias("_a"))
    right = b.select(*keys, F.struct(*columns).alias("_b"))
    issue = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return left.join(right, keys, "full").withColumn("issue", issue).where(F.col("issue").isNotNull()).select(*keys, "issue")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def edge_and_middle(df: DataFrame, group: str, order: list[str], key: str) -> DataFrame:
    """``group, first_id, middle_id, last_id`` by an order within each group.

    Positions come from counts per page of the order's first column, so no group is sorted in one task; only the
    rows of the wanted page are.
    """
    page = order[0]
    per_page = df.groupBy(group, page).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(group).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    placed = per_page.withColumn("_upto", F.sum("_n").over(run)).withColumn("_total", F.sum("_n").over(Window.partitionBy(group)))
    middle = F.floor(F.col("_total") / 2)
    wanted = placed.withColumn("_at", F.explode(F.array(F.lit(0).cast("long"), middle, F.col("_total") - 1))).where(
        (F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n"))
    )
    wanted = wanted.select(group, page, (F.col("_at") - F.col("_upto") + F.col("_n")).alias("_skip"), (F.col("_at") == 0).alias("_first"), (F.col("_at") == F.col("_total") - 1).alias("_last"), (F.col("_at") == middle).alias("_middle"))
    inside = Window.partitionBy(group, page).orderBy(*order[1:])
    numbered = df.join(wanted.select(group, page).distinct(), [group, page], "left_semi").withColumn("_skip", F.row_number().over(inside).cast("long") - 1)
    hit = numbered.join(wanted, [group, page, "_skip"])
    return hit.groupBy(group).agg(
        F.max(F.when(F.col("_first"), F.col(key))).alias("first_id"), F.max(F.when(F.col("_middle"), F.col(key))).alias("middle_id"), F.max(F.when(F.col("_last"), F.col(key))).alias("last_id")
    )
