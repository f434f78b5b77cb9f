"""Retail tables derived from the given `events`, `embeddings` and `conversations` tables.

Two clocks: `us` (calendar time) for day and hour jobs, and `fast_us` (600 times
compressed) for jobs whose thresholds are seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: person, camera, place in the frame, and both clocks."""
    e = table(spark, sf_dir, "events").select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        ((F.col("event_id") * 37) % 100).cast("int").alias("j"),
    )
    return e.select(
        "event_id",
        "us",
        F.expr(f"{START_US} + (us - {START_US}) div 600").alias("fast_us"),
        F.concat(F.lit("camera_"), (F.col("event_id") % 6 + 1).cast("string")).alias("camera_id"),
        (F.col("user_id") % 97).alias("track_id"),
        F.when(F.col("event_id") % 10 != 0, F.col("user_id").cast("string")).alias("global_id"),
        (F.col("k").cast("double") / 100).alias("cx"),
        (F.col("j").cast("double") / 100).alias("cy"),
        F.expr("cast((k * 1920) div 100 as int)").alias("px"),
        F.expr("cast((j * 1080) div 100 as int)").alias("py"),
        F.when(F.col("user_id") % 3 == 0, "male").when(F.col("user_id") % 3 == 1, "female").otherwise("unknown").alias("gender"),
        F.when(F.col("user_id") % 4 == 0, "young").when(F.col("user_id") % 4 == 1, "teenager").when(F.col("user_id") % 4 == 2, "adult").otherwise("senior").alias("age"),
        "event_type",
        "value",
        "k",
        "j",
        "user_id",
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trk(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.expr("us div 1000").alias("ts"), "camera_id", "track_id", "cx", "cy", "gender", F.col("age").alias("age_group")
    )


def tracking(spark: SparkSession, sf_dir: str, clock: str = "us") -> DataFrame:
    """Tracking log with `ts_us` from the given clock; zones are a 4 x 4 grid, unknown near the bottom."""
    zone = F.when(F.col("j") >= 90, "unknown").otherwise(F.concat(F.lit("zone_"), F.expr("k div 25"), F.lit("_"), F.expr("j div 25")))
    return trk(spark, sf_dir).select(
        "event_id",
        F.col(clock).alias("ts_us"),
        "camera_id",
        "track_id",
        "global_id",
        (F.col("px") - 40).alias("x1"),
        (F.col("py") - 160).alias("y1"),
        (F.col("px") + 40).alias("x2"),
        F.col("py").alias("y2"),
        zone.alias("zone"),
        "gender",
        F.col("age").alias("age_category"),
    )


def keypoints(spark: SparkSession, sf_dir: str, places: dict[str, tuple[str, str, str]]) -> DataFrame:
    """One row per event with `points`, a map of name to struct<x, y, conf>: expressions of x, y and ten times the confidence."""
    point = lambda x, y, n: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"), (F.expr(n).cast("double") / 10).alias("conf"))
    return trk(spark, sf_dir).withColumn("points", F.create_map(*[v for name, (x, y, n) in places.items() for v in (F.lit(name), point(x, y, n))]))


def in_stores(df: DataFrame) -> DataFrame:
    """The rows dealt to two stores, whose persons, tracks and cameras have the same ids."""
    return df.withColumn("store_id", F.concat(F.lit("store_"), F.expr("event_id div 3 % 2")))


def occupancy_log(spark: SparkSession, sf_dir: str, clock: str = "us") -> DataFrame:
    kind = F.when(F.col("event_type").isin("signup", "view"), "entry").when(F.col("event_type") == "purchase", "exit")
    return trk(spark, sf_dir).select("event_id", F.col(clock).alias("ts_us"), kind.alias("event_type"), "track_id", "camera_id").where("event_type is not null")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("us div 60000000 * 60").alias("ts")
    return trk(spark, sf_dir).select("camera_id", t).distinct().withColumn("path", F.concat_ws("/", "camera_id", "ts"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row per person and 5-second snapshot of the fast clock, in world units."""
    t = trk(spark, sf_dir).withColumn("snap", F.expr("fast_us div 5000000"))
    last = t.groupBy("snap", "user_id").agg(F.max_by(F.struct("k", "j", "camera_id"), "event_id").alias("r"))
    return last.select("snap", F.col("user_id").alias("person"), F.col("r.k").alias("world_x"), F.col("r.j").alias("world_y"))


def flagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        trk(spark, sf_dir)
        .where("event_type = 'error'")
        .select(F.col("event_id").cast("string").alias("id"), F.expr("us div 1000").alias("ts"), "camera_id", "global_id", "event_type", (F.col("event_id") % 2).cast("int").alias("reviewed"))
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trk(spark, sf_dir).select("event_id", F.concat(F.lit("10.0.0."), F.col("track_id")).alias("ip"), (F.col("event_type") != "error").alias("ok"), F.col("fast_us").alias("ts_us"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered embeddings: five per identity, around the identity's first vector.

    Identities with gid % 10 = 1 copy the centre of the one before; for
    gid % 10 = 5 the fifth vector is left unmixed.
    """
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    v = v.withColumn("gid", F.expr("vec_id div 5"))
    centre = v.where("vec_id % 5 = 0").select(F.col("gid").alias("cgid"), F.col("e").alias("c"))
    w = F.when((F.col("gid") % 10 == 5) & (F.col("vec_id") % 5 == 4), F.lit(0.0)).otherwise(1.0 + F.col("vec_id") % 4)
    v = v.withColumn("w", w).withColumn("cgid", F.when(F.col("gid") % 10 == 1, F.col("gid") - 1).otherwise(F.col("gid")))
    mixed = F.zip_with("c", "e", lambda a, b: F.col("w") * a + b)
    v = v.join(centre, "cgid").withColumn("m", mixed)
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    return v.select(
        "vec_id",
        "gid",
        F.transform("m", lambda x: x / norm).alias("embedding"),
        ((F.col("vec_id") * 13) % 100).cast("double").alias("quality"),
        F.concat(F.lit("camera_"), (F.col("vec_id") % 6 + 1).cast("string")).alias("camera_id"),
        F.col("vec_id").alias("ts"),
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text")


#: The same tables as DuckDB common table expressions.
SQL = """
e AS (
  SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         CAST((event_id * 37) % 100 AS INT) AS j
  FROM events
), trk AS (
  SELECT event_id, us, 1704067200000000 + (us - 1704067200000000) // 600 AS fast_us, 'camera_' || CAST(event_id % 6 + 1 AS VARCHAR) AS camera_id,
         user_id % 97 AS track_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS global_id,
         CAST(k AS DOUBLE) / 100 AS cx, CAST(j AS DOUBLE) / 100 AS cy, CAST((k * 1920) // 100 AS INT) AS px, CAST((j * 1080) // 100 AS INT) AS py,
         CASE user_id % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS gender,
         CASE user_id % 4 WHEN 0 THEN 'young' WHEN 1 THEN 'teenager' WHEN 2 THEN 'adult' ELSE 'senior' END AS age,
         event_type, value, k, j, user_id
  FROM e
), positions AS (
  SELECT event_id AS id, us // 1000 AS ts, camera_id, track_id, cx, cy, gender, age AS age_group FROM trk
), tr AS (
  SELECT event_id, us, fast_us, camera_id, track_id, global_id, px - 40 AS x1, py - 160 AS y1, px + 40 AS x2, py AS y2,
         CASE WHEN j >= 90 THEN 'unknown' ELSE 'zone_' || (k // 25) || '_' || (j // 25) END AS zone, gender, age AS age_category,
         coalesce(nullif(global_id, ''), camera_id || '_' || track_id) AS person
  FROM trk
), occ AS (
  SELECT event_id, us, fast_us, CASE WHEN event_type = 'purchase' THEN 'exit' ELSE 'entry' END AS event_type, track_id, camera_id
  FROM trk WHERE event_type IN ('signup', 'view', 'purchase')
), frames AS (
  SELECT DISTINCT camera_id, us // 60000000 * 60 AS ts, camera_id || '/' || (us // 60000000 * 60) AS path FROM trk
), snaps AS (
  SELECT fast_us // 5000000 AS snap, user_id AS person, max_by(k, event_id) AS world_x, max_by(j, event_id) AS world_y FROM trk GROUP BY ALL
), flagged AS (
  SELECT CAST(event_id AS VARCHAR) AS id, us // 1000 AS ts, camera_id, global_id, event_type, CAST(event_id % 2 AS INT) AS reviewed
  FROM trk WHERE event_type = 'error'
)
"""

#: Store of a row, as in `in_stores`.
STORE_SQL = "'store_' || (event_id // 3 % 2)"

#: The clustered vectors, as a table expression of its own.
VECTORS_SQL = """
v0 AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(vec_id // 5 AS BIGINT) AS gid FROM embeddings),
v1 AS (
  SELECT v.vec_id, v.gid, v.e, c.e AS c, CASE WHEN v.gid % 10 = 5 AND v.vec_id % 5 = 4 THEN 0.0::DOUBLE ELSE (1 + v.vec_id % 4)::DOUBLE END AS w
  FROM v0 v JOIN v0 c ON c.vec_id = 5 * (CASE WHEN v.gid % 10 = 1 THEN v.gid - 1 ELSE v.gid END)
), v2 AS (SELECT vec_id, gid, list_transform(list_zip(c, e), lambda p: w * p[1] + p[2]) AS m FROM v1),
vec AS (
  SELECT vec_id, gid, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS embedding,
         CAST((vec_id * 13) % 100 AS DOUBLE) AS quality, 'camera_' || CAST(vec_id % 6 + 1 AS VARCHAR) AS camera_id, vec_id AS ts
  FROM v2
)
"""
