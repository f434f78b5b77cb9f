"""Readers and writers of the retail logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.columns import clamp01

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


TRACKING = _schema(
    ("client_id", _S), ("store_id", _S), ("camera_id", _S), ("timestamp", _S), ("track_id", _L), ("global_id", _S), ("x1", _I), ("y1", _I), ("x2", _I), ("y2", _I), ("zone", _S),
    ("gender", _S), ("age_category", _S), ("store_occupancy", _I), ("has_entered", _S), ("first_zone_after_entry", _S), ("crossing_status", _S),
)
OCCUPANCY = _schema(("timestamp", _S), ("event_type", _S), ("track_id", _L), ("camera_id", _S))
POSITIONS = _schema(
    ("id", _L), ("ts", _L), ("camera_id", _S), ("track_id", _L), ("cx", T.DoubleType()), ("cy", T.DoubleType()), ("gender", _S), ("age_group", _S)
)


def _typed(df: DataFrame) -> DataFrame:
    """Timestamps parsed; rows whose time is no time (repeated headers, broken lines) go."""
    df = df.withColumn("timestamp", F.try_to_timestamp("timestamp")).where("timestamp is not null")
    if "has_entered" in df.columns:
        df = df.withColumn("has_entered", F.when(F.lower("has_entered") == "true", True).when(F.lower("has_entered") == "false", False))
    return df


def read_log(spark: SparkSession, path: str, schema: T.StructType = TRACKING) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of a log's CSV parts: every line is in one of them.

    rejected: file, reason, line.  A line whose time is no time is rejected: as
    `header` where it repeats the column names, as `malformed` where its cells
    don't fit the columns, else as `no time`.  A line with a time is kept; a cell
    of it that doesn't fit its column is NULL.
    """
    raw = spark.read.schema(T.StructType([*schema.fields, T.StructField("_line", _S)])).csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_line")
    raw = raw.select(*schema.names, "_line", F.col("_metadata.file_path").alias("_file"))
    timeless = F.try_to_timestamp("timestamp").isNull()
    reason = F.when(F.col("timestamp") == "timestamp", "header").when(F.col("_line").isNotNull(), "malformed").otherwise("no time")
    rejected = raw.where(timeless).select(F.col("_file").alias("file"), reason.alias("reason"), F.coalesce("_line", F.to_csv(F.struct(*schema.names))).alias("line"))
    return _typed(raw.drop("_line", "_file")), rejected


def read_tracking_log(spark: SparkSession, path: str) -> DataFrame:
    """CSV parts with the fixed 17 columns; header lines and malformed rows are tolerated."""
    return _typed(spark.read.schema(TRACKING).csv(path, mode="PERMISSIVE"))


def stream_tracking_log(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.readStream.schema(TRACKING).option("recursiveFileLookup", "true").csv(path))


def read_occupancy_log(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.schema(OCCUPANCY).csv(path, mode="PERMISSIVE"))


def clamp_positions(df: DataFrame) -> DataFrame:
    return df.withColumn("cx", clamp01("cx")).withColumn("cy", clamp01("cy"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV where the path says so; points clamped to the frame."""
    r = spark.read.schema(POSITIONS)
    return clamp_positions(r.csv(path, header=True) if path.endswith(".csv") else r.parquet(path))


_POINTS = "array<array<double>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Nested client / store / camera JSON to one row per zone, in the file's order."""
    camera = f"struct<type:string,zones:array<struct<sector_name:string,polygon_vertices:{_POINTS}>>,entrance_line:{_POINTS},inside_direction:string>"
    rows = _json(spark, path, f"map<string,map<string,map<string,{camera}>>>")
    rows = rows.select(F.explode("j").alias("client_id", "s")).select("client_id", F.explode("s").alias("store_id", "c")).select("client_id", "store_id", F.explode("c").alias("camera_id", "v"))
    vertices = F.transform("z.polygon_vertices", lambda p: F.struct(p[0].cast("int").alias("x"), p[1].cast("int").alias("y")))
    return rows.select("client_id", "store_id", "camera_id", F.posexplode("v.zones").alias("zone_idx", "z")).select(
        "client_id", "store_id", "camera_id", "zone_idx", F.col("z.sector_name").alias("zone"), vertices.alias("vertices")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Entrance lines of the zones file: camera_id, x1, y1, x2, y2, inside_direction (default left)."""
    camera = f"struct<entrance_line:{_POINTS},inside_direction:string>"
    rows = _json(spark, path, f"map<string,map<string,map<string,{camera}>>>")
    rows = rows.select(F.explode("j").alias("client_id", "s")).select("client_id", F.explode("s").alias("store_id", "c")).select("client_id", "store_id", F.explode("c").alias("camera_id", "v"))
    at = lambda i, k: F.col("v.entrance_line")[i][k].cast("int")
    return rows.where("v.entrance_line is not null").select(
        "client_id", "store_id", "camera_id", at(0, 0).alias("x1"), at(0, 1).alias("y1"), at(1, 0).alias("x2"), at(1, 1).alias("y2"), F.coalesce("v.inside_direction", F.lit("left")).alias("inside_direction")
    )


def read_homographies(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, f"map<string,struct<H:{_POINTS}>>").select(F.explode("j").alias("camera_id", "v"))
    return rows.where("v.H is not null").select("camera_id", *[F.col("v.H")[i][k].alias(f"h{i}{k}") for i in range(3) for k in range(3)])


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, "map<string,struct<name:string,source:string,type:string,enabled:boolean,area_description:string,aliases:array<string>>>")
    rows = rows.select(F.explode("j").alias("camera_id", "v")).select("camera_id", "v.*")
    return rows.withColumn("enabled", F.coalesce("enabled", F.lit(True))).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def normalise_for_log(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text cells in a fixed order: NULL is empty, booleans are lower case."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def landing_columns(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    t = F.col(ts)
    return df.withColumn("year", F.year(t)).withColumn("month", F.month(t)).withColumn("day", F.dayofmonth(t))


LANDING = ["client_id", "store_id", "year", "month", "day"]


def write_landing(df: DataFrame, path: str, ts: str = "timestamp", files_per_day: int = 1) -> None:
    """Append under client_id=/store_id=/year=/month=/day=; a busy store-day spreads over files_per_day files."""
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_day))
    landing_columns(df, ts).repartition(*LANDING, spread).write.mode("append").partitionBy(*LANDING).parquet(path)
