"""Links in markdown texts, and those that lead nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import link_kind


def links(files: DataFrame, file: str, text: str, pattern: str) -> DataFrame:
    """``file, line, target``: every link outside fenced code, with its line number from 1.

    The open fence is carried along the lines inside the row, so no line leaves it before the links are found.
    """
    lines = F.split(F.col(text), "\n")
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<boolean>").alias("skip"))
    fence = lambda line: line.rlike(r"^\s*(?:```|~~~)")
    skip = F.aggregate(
        lines, start, lambda s, x: F.struct((s["open"] != fence(x)).alias("open"), F.array_append(s["skip"], s["open"] | fence(x)).alias("skip")), lambda s: s["skip"]
    )
    held = files.where(F.col(text).isNotNull()).select(file, F.posexplode(F.arrays_zip(lines.alias("line"), skip.alias("skip"))).alias("pos", "z")).where(~F.col("z.skip"))
    return held.select(file, (F.col("pos") + 1).cast("long").alias("line"), F.explode(F.regexp_extract_all("z.line", F.lit(pattern), F.lit(1))).alias("target"))


def resolved(file: Column, target: Column) -> Column:
    """The path that a relative target names, seen from the folder of ``file``: without fragment, ``.`` and ``..``."""
    folder = F.regexp_replace(file, r"[^/]*$", "")
    path = F.regexp_replace(F.substring_index(F.trim(target), "#", 1), "%20", " ")
    parts = F.filter(F.split(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path)), "/"), lambda p: (p != "") & (p != "."))
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    climbs = lambda kept, p: (p == "..") & (F.size(kept) > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")) != "..")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda kept, p: F.when(climbs(kept, p), up(kept)).otherwise(F.array_append(kept, p)))
    return F.array_join(walked, "/")


def dead_links(found: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """Relative links of ``file`` whose target, seen from the file's folder, is no known path nor a folder of one."""
    relative = found.where(link_kind(F.col("target")) == "relative").withColumn("_path", resolved(F.col("file"), F.col("target")))
    parts = F.split(F.col(path), "/")
    paths = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("_path")).distinct()
    return relative.join(paths, "_path", "left_anti").drop("_path")
