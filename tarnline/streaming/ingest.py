"""Incremental ingest: micro-batches of chunks upserted into a namespaced table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.namespaces import upserted, write_namespaces


#: Buckets of a namespace; a batch rewrites those that its ids fall into, and no others.
BUCKETS = 64


def upsert_batch(batch: DataFrame, path: str, keys: list[str], order: str, batch_id: int = 0) -> None:
    """Merges one micro-batch into the table at ``path``; running it again changes nothing.

    The table is partitioned by namespace and by a hash bucket of the key, so only the buckets that the batch touches
    are read and replaced. The merged rows are written beside the table first, under the number of the batch, since a
    partition cannot be overwritten while it is read; a run cut short is mended by running the batch again.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*[k for k in keys if k != "namespace"]), F.lit(BUCKETS)).cast("int")
    incoming = batch.withColumn("bucket", bucket)
    touched = incoming.select("namespace", "bucket").distinct()
    if touched.isEmpty():
        return
    try:
        held = spark.read.schema(incoming.schema).parquet(path).select(*incoming.columns)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        held = incoming.where("false")
    # pairs of labels and bucket numbers, so that whole partitions are pruned; their number is bounded by the buckets
    pairs = [F.struct(F.lit(r["namespace"]).alias("namespace"), F.lit(r["bucket"]).alias("bucket")) for r in touched.collect()]
    staged = f"{path}.staged-{batch_id}"
    mine = held.where(F.struct("namespace", "bucket").isin(pairs))
    upserted(mine, incoming, keys, order).write.mode("overwrite").parquet(staged)
    write_namespaces(spark.read.parquet(staged), path, by=("namespace", "bucket"))


def ingest_stream(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, keys: tuple[str, ...] = ("namespace", "id"), order: str = "ingest_id") -> DataStreamWriter:
    """A stream of parquet files under ``source`` upserted into ``path``; start it with a trigger of your choice."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: upsert_batch(batch, path, list(keys), order, number))


def rates_by_window(events: DataFrame, time: str, late: str, width: str, by: str, value: str) -> DataFrame:
    """``start, by, n, total`` per tumbling window; rows later than ``late`` behind the newest are left out."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
