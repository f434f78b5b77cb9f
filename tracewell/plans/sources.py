"""Queries of the readers and writers: derived tables written in the logs' formats, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.sources import adapters as X
from tracewell.sources import logs as L
from tracewell.sources.shared import new_folder
from tracewell.streaming import jobs as T

Q, S = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = f"WITH {X.SQL} {sql}"
        return f

    return keep


def tracking_log(spark, d, *more):
    """The tracking table in the log's 17 columns, and more of its own."""
    t = X.tracking(spark, d)
    third = F.col("event_id") % 3
    return t.select(
        *more, F.lit("c1").alias("client_id"), F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")).alias("store_id"), "camera_id", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "track_id", "global_id", "x1", "y1", "x2", "y2", "zone", "gender", "age_category", (F.col("event_id") % 7).cast("int").alias("store_occupancy"),
        F.when(third > 0, third == 1).alias("has_entered"), F.when(third == 1, F.col("zone")).alias("first_zone_after_entry"), F.when(third == 1, "entered").otherwise("none").alias("crossing_status"),
    )


def written_log(spark, d) -> str:
    """The log as CSV parts, with a header line repeated as data and a broken line."""
    names = L.TRACKING.names
    broken = ["c1", "s1", "camera_1", "not a time", *[""] * (len(names) - 4)]
    odd = spark.createDataFrame([tuple(names), tuple(broken)], ", ".join(f"{n} string" for n in names))
    path = new_folder(spark, "tracking")
    L.normalise_for_log(tracking_log(spark, d), names).union(odd).write.csv(path)
    return path


LOG = (
    "SELECT 's' || (event_id % 2) AS store_id, camera_id, us, track_id, global_id, x1, y2, zone, gender, age_category, CAST(event_id % 7 AS INT) AS store_occupancy, "
    "CASE event_id % 3 WHEN 1 THEN true WHEN 2 THEN false END AS has_entered, CASE WHEN event_id % 3 = 1 THEN zone END AS first_zone_after_entry, "
    "CASE WHEN event_id % 3 = 1 THEN 'entered' ELSE 'none' END AS crossing_status FROM tr"
)


def _log_columns(log):
    kept = ["track_id", "global_id", "x1", "y2", "zone", "gender", "age_category", "store_occupancy", "has_entered", "first_zone_after_entry", "crossing_status"]
    return log.select("store_id", "camera_id", F.unix_micros("timestamp").alias("us"), *kept)


@query("io1_read_tracking_log", LOG)
def io1(spark, d):
    return _log_columns(L.read_tracking_log(spark, written_log(spark, d)))


@query(
    "io1_rejected_lines",
    "SELECT 'read' AS reason, count(*) AS lines, count(*) FILTER (event_id % 13 <> 0) AS whole FROM trk WHERE event_id % 11 <> 0 "
    "UNION ALL SELECT CASE WHEN event_id % 13 = 0 THEN 'malformed' ELSE 'no time' END, count(*), 0 FROM trk WHERE event_id % 11 = 0 GROUP BY 1 UNION ALL SELECT 'header', count(*), 0 FROM trk WHERE event_id < 3",
)
def io1_rejected(spark, d):
    """A log in which some rows have no time, some a broken cell, some both, and three lines repeat the header."""
    names, e = L.TRACKING.names, F.col("event_id")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names]
    log = tracking_log(spark, d, "event_id").select("event_id", *cells)
    log = log.withColumn("timestamp", F.when(e % 11 == 0, F.concat(F.lit("at some time "), e)).otherwise(F.col("timestamp"))).withColumn("x1", F.when(e % 13 == 0, "far left").otherwise(F.col("x1")))
    path = new_folder(spark, "rejects")
    log.select(*names).union(log.where("event_id < 3").select(*[F.lit(c) for c in names])).write.csv(path)
    rows, rejected = L.read_log(spark, path)
    read = rows.agg(F.lit("read").alias("reason"), F.count("*").alias("lines"), F.count("x1").alias("whole"))
    return read.union(rejected.where("file is not null").groupBy("reason").agg(F.count("line").alias("lines"), F.lit(0).cast("long").alias("whole")))


@query("io2_read_positions", "SELECT id, ts, camera_id, track_id, greatest(0, least(1, 2 * cx - 0.5)) AS cx, greatest(0, least(1, 2 * cy - 0.5)) AS cy, gender, age_group FROM positions")
def io2_read(spark, d):
    """Half of the rows come back from Parquet, half from CSV; points outside the frame are clamped."""
    wide = X.positions(spark, d).withColumn("cx", 2 * F.col("cx") - 0.5).withColumn("cy", 2 * F.col("cy") - 0.5)
    path = new_folder(spark, "positions")
    wide.where("id % 2 = 0").write.parquet(f"{path}/a")
    wide.where("id % 2 = 1").write.csv(f"{path}/b.csv", header=True)
    return L.read_positions(spark, f"{path}/a").unionByName(L.read_positions(spark, f"{path}/b.csv"))


@query("io3_read_occupancy_log", "SELECT us, event_type, track_id, camera_id FROM occ")
def io3(spark, d):
    path = new_folder(spark, "occupancy")
    time = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    L.normalise_for_log(X.occupancy_log(spark, d).withColumn("timestamp", time), L.OCCUPANCY.names).write.csv(path)
    return L.read_occupancy_log(spark, path).select(F.unix_micros("timestamp").alias("us"), "event_type", "track_id", "camera_id")


ZONES = "z AS (SELECT DISTINCT camera_id, k // 25 AS a, j // 25 AS b FROM trk)"


@query(
    "io4_read_zones",
    f", {ZONES} SELECT 'c1' AS client_id, 's1' AS store_id, camera_id, CAST(row_number() OVER (PARTITION BY camera_id ORDER BY a, b) - 1 AS INT) AS zone_idx, 'zone_' || a || '_' || b AS zone, "
    "[CAST(480 * a AS INT), CAST(480 * a + 480 AS INT), CAST(480 * a + 480 AS INT)] AS xs, [CAST(270 * b AS INT), CAST(270 * b AS INT), CAST(270 * b + 270 AS INT)] AS ys FROM z",
)
def io4(spark, d):
    z = X.trk(spark, d).select("camera_id", F.expr("k div 25").alias("a"), F.expr("j div 25").alias("b")).distinct()
    x, y = F.col("a") * 480, F.col("b") * 270
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    zone = F.struct("a", "b", F.concat_ws("_", F.lit("zone"), "a", "b").alias("sector_name"), F.array(point(x, y), point(x + 480, y), point(x + 480, y + 270)).alias("polygon_vertices"))
    # a camera has at most 16 zones, the store one row of configuration
    cameras = z.groupBy("camera_id").agg(F.transform(F.array_sort(F.collect_list(zone)), lambda s: s.dropFields("a", "b")).alias("zones"))
    config = cameras.agg(F.map_from_entries(F.collect_list(F.struct("camera_id", F.struct(F.lit("polygon").alias("type"), "zones")))).alias("cameras"))
    path = new_folder(spark, "zones")
    config.select(F.to_json(F.create_map(F.lit("c1"), F.create_map(F.lit("s1"), "cameras")))).coalesce(1).write.text(path)
    part = lambda name: F.transform("vertices", lambda p: p[name])
    return L.read_zones(spark, path).select("client_id", "store_id", "camera_id", "zone_idx", "zone", part("x").alias("xs"), part("y").alias("ys"))


@query(
    "io4_read_homographies",
    "SELECT camera_id, " + ", ".join(f"CAST({'min(k)' if i == j else f'max(j) + {i} - {j}'} AS DOUBLE) AS h{i}{j}" for i in range(3) for j in range(3)) + " FROM trk WHERE camera_id <> 'camera_3' GROUP BY 1",
)
def io4_homographies(spark, d):
    cell = lambda i, j: (F.min("k") if i == j else F.max("j") + i - j).cast("double")
    rows = X.trk(spark, d).groupBy("camera_id").agg(F.array(*[F.array(*[cell(i, j) for j in range(3)]) for i in range(3)]).alias("h"))
    value = F.struct(F.when(F.col("camera_id") != "camera_3", F.col("h")).alias("H"))
    path = new_folder(spark, "homographies")
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("camera_id", value))))).coalesce(1).write.text(path)
    return L.read_homographies(spark, path)


@query("io4_read_cameras", "SELECT DISTINCT camera_id, 'Camera ' || camera_id AS name, camera_id <> 'camera_3' AS enabled, CASE WHEN camera_id = 'camera_2' THEN 1 ELSE 0 END AS n_aliases FROM trk")
def io4_cameras(spark, d):
    rows = X.trk(spark, d).select("camera_id").distinct()
    value = F.struct(
        F.concat(F.lit("Camera "), "camera_id").alias("name"),
        F.when(F.col("camera_id") == "camera_3", False).alias("enabled"),
        F.when(F.col("camera_id") == "camera_2", F.array(F.lit("till"))).alias("aliases"),
    )
    path = new_folder(spark, "cameras")
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("camera_id", value))))).coalesce(1).write.text(path)
    return L.read_cameras(spark, path).select("camera_id", "name", "enabled", F.size("aliases").alias("n_aliases"))


@query("io5_write_landing", "SELECT 'c1' AS client_id, 's' || (event_id % 2) AS store_id, strftime(make_timestamp(us), '%Y-%m-%d') AS day, count(*) AS rows, sum(track_id)::BIGINT AS tracks FROM tr GROUP BY ALL")
def io5(spark, d):
    path = new_folder(spark, "landing")
    log = tracking_log(spark, d).withColumn("timestamp", F.to_timestamp("timestamp"))
    L.write_landing(log, path, files_per_day=2)
    day = F.date_format(F.make_date("year", "month", "day"), "yyyy-MM-dd").alias("day")
    return spark.read.parquet(path).groupBy("client_id", "store_id", day).agg(F.count("*").alias("rows"), F.sum("track_id").alias("tracks"))


@query("io7_stream_tracking_log", LOG)
def io7(spark, d):
    return _log_columns(T.run_available(L.stream_tracking_log(spark, written_log(spark, d))))
