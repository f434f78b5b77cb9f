"""Flagged events as a table that a stream of changes keeps up to date.

The table lies in buckets by event id, and a bucket in one folder per batch that
changed it: `bucket=b/batch=n`.  The newest batch of a bucket is its state.  A
batch reads, of the buckets that it touches, the newest state before it, merges
its changes, and overwrites its own folders only; done again after a crash it
reads the same and writes the same.  A batch costs the size of the buckets that
it touches, not of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.alerts import merge_events

BUCKETS = 64


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])


def _newest(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The newest rows of each bucket, of batches before one; a row without an id only keeps a bucket's folder."""
    try:
        rows = spark.read.schema(_stored(schema)).parquet(path)
    except Exception as e:  # no batch has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _stored(schema))
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    # a row per bucket
    last = rows.groupBy(F.col("bucket").alias("_b")).agg(F.max("batch").alias("_n"))
    return rows.join(F.broadcast(last), (F.col("bucket") == F.col("_b")) & (F.col("batch") == F.col("_n")), "left_semi")


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table as of its last batch."""
    return _newest(spark, path, schema).where("id is not null").select(*schema.names)


def apply_batch(changes: DataFrame, batch: int, path: str, schema: T.StructType, buckets: int = BUCKETS) -> None:
    """Merge one batch of changes (op, seq, and the columns of the table) into the table."""
    spark = changes.sparkSession
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    changes = changes.persist()
    try:
        touched = sorted(r.b for r in changes.select(bucket.alias("b")).distinct().collect())  # at most `buckets`
        if not touched:
            return
        base = _newest(spark, path, schema, batch, touched).where("id is not null").select(*schema.names)
        merged = merge_events(base, changes).select(*schema.names).withColumn("bucket", bucket)
        held = spark.createDataFrame([(b,) for b in touched], "bucket int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema], "bucket")
        rows = merged.unionByName(held).withColumn("batch", F.lit(batch).cast("long"))
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
    finally:
        changes.unpersist()


def upsert_stream(changes: DataFrame, path: str, checkpoint: str, schema: T.StructType, buckets: int = BUCKETS, every: str | None = None):
    """Start the stream that applies changes batch by batch; without `every` it takes what is there and ends."""
    w = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: apply_batch(df, n, path, schema, buckets))
    return (w.trigger(availableNow=True) if every is None else w.trigger(processingTime=every)).start()
