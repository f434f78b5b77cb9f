"""Rendezvous sharding of records over weighted shards.

Each (record, shard) pair gets a hash; the record goes to the shard with the
highest weighted score.  A new shard only takes records for which it wins, so
no record moves between old shards.  Built-in functions only; no shuffle for
the placement itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.frames import col, read

SEED = 0x5EED


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard 0..len(weights)-1 of a record key.

    score = -weight / ln(u), u in (0, 1) from a 64-bit hash of key and shard.
    With equal weights the order of the scores is that of the hashes, and the
    logarithm is left out.  Ties go to the higher shard number.  A null key is
    a key like any other.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative and one at least positive")
    scores = []
    even = len(set(weights)) == 1
    for shard, weight in enumerate(weights):
        if weight == 0:
            continue
        h = F.xxhash64(key.cast("string"), F.lit(shard), F.lit(SEED))
        if not even:
            u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
            h = -F.lit(float(weight)) / F.ln(u)
        scores.append(F.struct(h.alias("score"), F.lit(shard).alias("shard")))
    return (F.greatest(*scores) if len(scores) > 1 else scores[0]).getField("shard")


def assign_shards(
    df: DataFrame,
    key: str,
    weights: Sequence[float],
    text: str = "text",
    rows_per_group: int = 1 << 20,
) -> DataFrame:
    """Placement of every row: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 16 (null text: 16); text_crc32 is
    unsigned (null text: of no bytes).  slot numbers the rows of a shard from 0
    without gaps, in the order of (sub-bucket, key, crc, size); rows equal in
    all of these are interchangeable.  grown_shard is the shard with one more
    shard of mean weight.

    Slots need no task that holds a shard: each shard is split into
    sub-buckets by another hash, numbered locally, and shifted by the sizes of
    the earlier sub-buckets.  Their number follows the row count, so a task
    numbers about `rows_per_group` rows at any scale; only rows equal in key,
    crc and size share a sub-bucket whatever their number (sorted there, of
    these columns alone).  Repeated rows and equal texts go where their key
    says; an empty table gives no rows.
    """
    more = [*weights, sum(weights) / len(weights)]
    body = F.coalesce(col(text), F.lit(""))
    placed = df.select(
        col(key).alias("_key"),
        (F.octet_length(body) + F.lit(16)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(col(key), weights).cast("int").alias("shard"),
        shard_of(col(key), more).cast("int").alias("grown_shard"),
    )
    groups = max(4, -(-df.select(F.lit(1)).count() // (rows_per_group * len(weights))))
    placed = placed.withColumn("_sub", F.pmod(F.xxhash64("_key", "text_crc32", "size"), F.lit(groups)).cast("int"))
    # one count per (shard, sub-bucket): shards x groups rows, whatever the texts are
    sizes = placed.groupBy("shard", "_sub").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        "shard",
        "_sub",
        (F.sum("_n").over(Window.partitionBy("shard").orderBy("_sub")) - F.col("_n")).alias("_offset"),
    )
    local = Window.partitionBy("shard", "_sub").orderBy("_key", "text_crc32", "size")
    return (
        placed.withColumn("_row", F.row_number().over(local))
        .join(offsets, ["shard", "_sub"])
        .select(
            F.col("_key").alias(key),
            "size",
            "text_crc32",
            "law",
            "shard",
            (F.col("_offset") + F.col("_row") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def write_shards(df: DataFrame, key: str, weights: Sequence[float], path: str, files_per_shard: int = 8) -> None:
    """Write whole rows under shard=N folders, `files_per_shard` files each at least."""
    placed = df.withColumn("shard", shard_of(col(key), weights))
    spread = F.pmod(F.xxhash64(col(key).cast("string")), F.lit(files_per_shard))
    placed.repartition(len(weights) * files_per_shard, "shard", spread).write.partitionBy("shard").parquet(path)


def op10_rendezvous(spark, sf_dir):
    """All documents over 40 even shards, and where they go with 41."""
    return assign_shards(read(spark, sf_dir, "documents"), "doc_id", [1.0] * 40)
