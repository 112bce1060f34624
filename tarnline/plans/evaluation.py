"""Evaluation queries. Scored rows come from the events table: its users stand for questions, its types for categories,
its two halves in time for the arms of a run; every 17th value is NaN and every 19th null, as judges leave them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import first_match, gains_and_losses, health, numeric, paired, rollup_means
from ..operators.runs import percentiles
from ..sources.tables import table
from .registry import query

_SCORES = """WITH scores AS (SELECT user_id, event_type AS category, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'base' ELSE 'now' END AS arm,
    CASE WHEN event_id % 17 = 0 THEN 'nan'::DOUBLE WHEN event_id % 19 = 0 THEN NULL ELSE value / 500 END AS value FROM events),
    numbers AS (SELECT user_id, category, arm, CASE WHEN isnan(value) THEN NULL ELSE value END AS v, value FROM scores),
    pairs AS (SELECT category, user_id, avg(v) FILTER (arm = 'base') AS base, avg(v) FILTER (arm = 'now') AS now FROM numbers GROUP BY 1, 2
              HAVING avg(v) FILTER (arm = 'base') IS NOT NULL AND avg(v) FILTER (arm = 'now') IS NOT NULL)
"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    value = F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).when(F.col("event_id") % 19 == 0, F.lit(None)).otherwise(F.col("value") / 500)
    arm = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "base").otherwise("now")
    return rows.select("user_id", F.col("event_type").alias("category"), arm.alias("arm"), value.alias("value"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(_scores(spark, sf_dir), ["category", "user_id"], "arm", "base", "now")


@query(_SCORES + "SELECT arm, count(*) AS n, count(v) AS n_numeric, count(*) - count(v) AS n_missing, round(avg(v), 6) AS mean FROM numbers GROUP BY 1")
def metric_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health(_scores(spark, sf_dir), ["arm"]).withColumn("mean", F.round("mean", 6))


@query(_SCORES + "SELECT arm, category, round(avg(v), 6) AS mean FROM numbers GROUP BY 1, 2")
def metric_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health(_scores(spark, sf_dir), ["arm", "category"]).select("arm", "category", F.round("mean", 6).alias("mean"))


@query(_SCORES + "SELECT arm, category, count(*) AS n, round(avg(v), 6) AS mean FROM numbers GROUP BY ROLLUP (arm, category)")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_means(_scores(spark, sf_dir), ["arm", "category"]).withColumn("mean", F.round("mean", 6))


@query(_SCORES + "SELECT category, round(avg(v) FILTER (arm = 'now') - avg(v) FILTER (arm = 'base'), 4) AS delta FROM numbers GROUP BY 1")
def metric_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(_scores(spark, sf_dir), ["category"], "arm", "base", "now").select("category", F.round("delta", 4).alias("delta"))


@query(_SCORES + "SELECT category, user_id, round(now - base, 9) AS delta FROM pairs")
def correctness_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("category", "user_id", F.round("delta", 9).alias("delta"))


@query(_SCORES + """SELECT category, count(*) AS n, count(*) FILTER (round(now - base, 9) >= 0.15) AS n_gains, count(*) FILTER (round(now - base, 9) <= -0.15) AS n_losses FROM pairs GROUP BY 1""")
def gains_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gains_and_losses(_pairs(spark, sf_dir), ["category"], 0.15)


@query(_SCORES + "SELECT category, count(*) AS n, round(avg(base), 6) AS base, round(avg(now), 6) AS now, round(avg(now) - avg(base), 6) AS delta FROM pairs GROUP BY 1")
def like_for_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of both arms over the questions that both arms scored."""
    means = _pairs(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("base").alias("b"), F.avg("now").alias("a"))
    return means.select("category", "n", F.round("b", 6).alias("base"), F.round("a", 6).alias("now"), F.round(F.col("a") - F.col("b"), 6).alias("delta"))


@query("""SELECT coalesce(d.category, '?') AS category, count(*) AS n, round(avg(confidence_score), 6) AS mean FROM askresponse a
    LEFT JOIN dataset d USING (eval_id) WHERE a.eval_id IS NOT NULL AND d.eval_id IS NOT NULL GROUP BY 1
    UNION ALL SELECT 'UNMATCHED', count(*), round(avg(confidence_score), 6) FROM askresponse a LEFT JOIN dataset d USING (eval_id) WHERE d.eval_id IS NULL HAVING count(*) > 0""")
def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of answers by the category of their question; asked-often questions are reduced before the join."""
    answers = table(spark, sf_dir, "askresponse", "eval_id", "confidence_score").groupBy("eval_id").agg(F.count(F.lit(1)).alias("k"), F.sum(numeric(F.col("confidence_score"))).alias("s"), F.count(numeric(F.col("confidence_score"))).alias("m"))
    asked = table(spark, sf_dir, "dataset", "eval_id", "category").withColumn("category", F.coalesce("category", F.lit("?")))
    joined = answers.join(asked, "eval_id", "left").withColumn("category", F.coalesce("category", F.lit("UNMATCHED")))
    return joined.groupBy("category").agg(F.sum("k").alias("n"), F.round(F.sum("s") / F.sum("m"), 6).alias("mean"))


@query("SELECT event_type, user_id % 3 AS fingerprint, count(*) AS n FROM events GROUP BY 1, 2")
def backend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_type", "user_id")
    return rows.groupBy("event_type", (F.col("user_id") % 3).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(DISTINCT user_id % 3) AS n_fingerprints, count(DISTINCT user_id % 3) > 1 AS drifted FROM events GROUP BY 1")
def backend_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_type", "user_id")
    return rows.groupBy("event_type").agg(F.count_distinct(F.col("user_id") % 3).alias("n_fingerprints")).withColumn("drifted", F.col("n_fingerprints") > 1)


@query("""WITH f AS (SELECT event_type AS category, user_id, max(event_id) FILTER (ts < TIMESTAMP '2024-01-16') % 3 AS was, max(event_id) FILTER (ts >= TIMESTAMP '2024-01-16') % 3 AS is_now FROM events GROUP BY 1, 2)
    SELECT category, count(*) AS n, count(*) FILTER (was = is_now) AS n_shared FROM f WHERE was IS NOT NULL AND is_now IS NOT NULL GROUP BY 1""")
def shared_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the questions that both arms scored, those whose last row bears the same fingerprint in both."""
    rows = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    last = rows.groupBy(F.col("event_type").alias("category"), "user_id").agg((F.max(F.when(early, F.col("event_id"))) % 3).alias("was"), (F.max(F.when(~early, F.col("event_id"))) % 3).alias("is_now"))
    both = last.where("was IS NOT NULL AND is_now IS NOT NULL")
    return both.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("was") == F.col("is_now")).alias("n_shared"))


@query("""WITH rules AS (SELECT doc_id, split_part(title, ' ', 1) AS word FROM manifest)
    SELECT doc_id, min(eval_id) AS eval_id FROM rules LEFT JOIN dataset ON regexp_matches(lower(question), '(^|[^\\p{L}\\p{N}])' || lower(word) || '($|[^\\p{L}\\p{N}])') GROUP BY 1""".replace("\\\\", "\\"))
def prediction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the first question that names its publisher's first word."""
    rules = table(spark, sf_dir, "manifest", "doc_id", "title").select("doc_id", F.split("title", " ")[0].alias("word"))
    return first_match(rules, table(spark, sf_dir, "dataset", "eval_id", "question"), "doc_id", "word", "eval_id", "question")


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS least, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles without ranking a type whole, beside its mean and extremes."""
    rows = table(spark, sf_dir, "events", "event_type", "value").where("value IS NOT NULL")
    simple = rows.groupBy("event_type").agg(F.min("value").alias("least"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))
    ranked = percentiles(rows, "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return simple.join(ranked, "event_type").select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "least", "mean", "most")


@query()
def run_record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON record of a run: counts, means of both arms and deltas by category."""
    by = like_for_like(spark, sf_dir)
    body = by.agg(F.array_sort(F.collect_list(F.struct("category", "n", "base", "now", "delta"))).alias("categories"))  # one entry a category
    return body.select(F.to_json(F.struct(F.lit("base").alias("baseline"), F.lit("now").alias("run"), "categories")).alias("record"))
