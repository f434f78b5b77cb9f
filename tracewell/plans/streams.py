"""Streaming queries: the derived tables as streams, run over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import alerts as E
from tracewell.plans import alerts as al
from tracewell.plans import sequences as seq
from tracewell.sources import adapters as X
from tracewell.streaming import gallery as G
from tracewell.streaming import jobs as T
from tracewell.streaming import live as L
from tracewell.streaming import upsert as U

Q, S = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = f"WITH {X.SQL} {sql}"
        return f

    return keep


class _Stream:
    """Stands for the session in the adapters: its events come as a stream.

    A stream reads folders or patterns, not the path of a single file.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    class _Read:
        def __init__(self, spark):
            self.spark = spark

        def parquet(self, path: str) -> DataFrame:
            return self.spark.readStream.schema(T.EVENTS).option("maxFilesPerTrigger", 8).parquet(path.removesuffix(".parquet") + "*.parquet")

    @property
    def read(self):
        return self._Read(self.spark)


def timed(df: DataFrame, us: str = "ts_us") -> DataFrame:
    return df.withColumn("time", F.timestamp_micros(us))


def tracking(spark, d, clock="fast_us"):
    return timed(X.tracking(_Stream(spark), d, clock))


@query("t1_stream_hourly_traffic", "SELECT make_timestamp(us // 3600000000 * 3600000000) AS hour, count(DISTINCT track_id) AS visitors FROM trk GROUP BY 1 HAVING max(us) // 3600000000 * 3600000000 + 3600000000 <= (SELECT max(us) FROM trk) - 600000000")
def t1(spark, d):
    out = T.run_available(T.hourly_traffic(timed(X.positions(_Stream(spark), d).withColumn("ts_us", F.col("ts") * 1000))))
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "visitors")


#: What the watermark has passed once all rows are read.
PASSED = "(SELECT max(fast_us) // 1000 * 1000 - 600000000 FROM trk)"


@query(
    "t2_stream_occupancy",
    f", r AS (SELECT {X.STORE_SQL} AS store, person, camera_id, fast_us AS ts, lead(fast_us) OVER (PARTITION BY {X.STORE_SQL}, person ORDER BY fast_us, event_id) AS next FROM tr), "
    "d AS (SELECT store, camera_id, ts AS at_us, 1 AS delta FROM r UNION ALL SELECT store, camera_id, least(coalesce(next, ts + 8000001), ts + 8000001), -1 FROM r), "
    f"s AS (SELECT store, camera_id, at_us, sum(delta) AS delta FROM d WHERE at_us <= {PASSED} GROUP BY ALL HAVING sum(delta) <> 0) "
    "SELECT store, camera_id, at_us, CAST(sum(delta) OVER (PARTITION BY store, camera_id ORDER BY at_us) AS BIGINT) AS persons FROM s",
)
def t2(spark, d):
    G.use_rocks(spark)
    return T.run_available(L.live_occupancy(X.in_stores(tracking(spark, d))))


@query(
    "t3_stream_presence",
    ", g AS (SELECT *, CASE WHEN fast_us - lag(fast_us) OVER w >= 60000000 THEN 1 ELSE 0 END AS new FROM tr WINDOW w AS (PARTITION BY person ORDER BY fast_us, event_id)), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY person ORDER BY fast_us, event_id) AS s FROM g) "
    "SELECT person, min(fast_us) AS start_us, max(fast_us) + 60000000 AS end_us, count(*) AS rows FROM s GROUP BY person, s HAVING max(fast_us) + 60000000 <= (SELECT max(fast_us) // 1000 * 1000 FROM trk) - 600000000",
)
def t3(spark, d):
    out = T.run_available(T.presence(tracking(spark, d)))
    return out.select("person", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "rows")


@query("t4_stream_crossings")
def t4(spark, d):
    return T.run_available(T.crossings(tracking(spark, d), seq.lines(spark)))


@query(
    "t5_stream_zone_state",
    seq.STOPS + " SELECT person, zone, cam, entry_us, exit_us, list(zone) OVER (PARTITION BY person ORDER BY stop ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS trail FROM stops WHERE exit_us IS NOT NULL",
)
def t5(spark, d):
    return T.run_available(T.zone_state(tracking(spark, d)))


@query(
    "t5_fleet_zone_state",
    seq.STOPS.replace("PARTITION BY person", f"PARTITION BY {X.STORE_SQL}, person").replace("SELECT person, stop", f"SELECT {X.STORE_SQL} AS store_id, person, stop").replace("lead(entry_us) OVER (PARTITION BY " + X.STORE_SQL, "lead(entry_us) OVER (PARTITION BY store_id")
    + " SELECT store_id, person, zone, cam, entry_us, exit_us, list(zone) OVER (PARTITION BY store_id, person ORDER BY stop ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS trail FROM stops WHERE exit_us IS NOT NULL",
)
def t5_fleet(spark, d):
    return T.run_available(T.zone_state(X.in_stores(tracking(spark, d)), by=["store_id"]))


@query("t6_stream_alerts")
def t6(spark, d):
    G.use_rocks(spark)
    log = timed(X.occupancy_log(_Stream(spark), d, "fast_us"))
    return T.run_available(L.alerts(X.in_stores(tracking(spark, d)), X.in_stores(log), E.COOLDOWNS, capacity=20, surge=8))


@query("t7_stream_camera_offline")
def t7(spark, d):
    pings = tracking(spark, d).where(f"camera_id <> 'camera_4' or ts_us < {X.START_US + 600_000_000}")
    return T.run_available(T.camera_offline(pings))


@query("t8_stream_to_landing", "SELECT strftime(make_timestamp(us), '%Y-%m-%d') AS day, count(*) AS rows FROM trk GROUP BY 1")
def t8(spark, d):
    path = T.new_folder(spark, "landing")
    log = timed(X.tracking(_Stream(spark), d)).withColumn("client_id", F.lit("c1")).withColumn("store_id", F.col("camera_id"))
    T.to_landing(log, f"{path}/rows", f"{path}/state", None, "time").awaitTermination()
    back = spark.read.parquet(f"{path}/rows")
    return back.groupBy(F.date_format(F.make_date("year", "month", "day"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("rows"))


#: Rows arrive in eight files by event_id; every 97th comes one file and a half late.
ARRIVAL = "least(7, (event_id * 8) // (SELECT max(event_id) + 1 FROM trk) + CASE WHEN event_id % 97 = 0 THEN 3 ELSE 0 END)"


LATE_SQL = (
    f", r AS (SELECT event_id, us // 1000 * 1000 AS us, {ARRIVAL} AS f FROM trk), m AS (SELECT f, max(us) AS top FROM r GROUP BY 1), "
    "w AS (SELECT x.f, max(y.top) - 600000000 AS low FROM m x JOIN m y ON y.f < x.f - 1 GROUP BY 1) "
)


def arrivals(spark, d):
    """The rows, and a stream of them in the order of ARRIVAL."""
    rows = X.trk(spark, d).select("event_id", F.expr("us div 1000 * 1000").alias("ts_us"))
    most = rows.agg((F.max("event_id") + 1).alias("most"))
    at = F.least(F.lit(7), F.expr("event_id * 8 div most") + F.when(F.col("event_id") % 97 == 0, 3).otherwise(0))
    rows = rows.crossJoin(most).withColumn("f", at).drop("most")
    path = T.new_folder(spark, "arrivals")
    for f in range(8):  # one after the other: a stream reads files by their time
        rows.where(F.col("f") == f).drop("f").coalesce(1).write.mode("append").parquet(path)
    return rows, timed(spark.readStream.schema("event_id long, ts_us long").option("maxFilesPerTrigger", 1).parquet(path))


@query("t9_late_rows", LATE_SQL + "SELECT us // 86400000000 AS day, count(*) AS rows, count(*) FILTER (coalesce(us <= low, false)) AS late FROM r LEFT JOIN w USING (f) GROUP BY 1")
def t9(spark, d):
    rows, stream = arrivals(spark, d)
    return T.late_rows(rows, T.run_available(T.on_time(stream)))


@query("t9_dropped_rows", LATE_SQL + "SELECT count(*) AS arrived, count(*) FILTER (coalesce(us <= low, false)) AS dropped, count(*) FILTER (NOT coalesce(us <= low, false)) AS kept FROM r LEFT JOIN w USING (f)")
def t9_dropped(spark, d):
    _, stream = arrivals(spark, d)
    kept, batches = T.counted(stream, T.on_time)
    return batches.agg(F.sum("arrived").alias("arrived"), F.sum("dropped").alias("dropped")).crossJoin(kept.agg(F.count("*").alias("kept")))


LABELS = ("gender", "upred", "upblue", "downred", "downblue", "hat")
GALLERY_RULES = G.labelled(G.Rules(window=5), LABELS)


def visits(spark, d):
    """Three visits of every identity to one of four stores: its five vectors, less alike each time,
    a minute after the first one and three hours later."""
    v = X.vectors(spark, d).withColumn("visit", F.explode(F.sequence(F.lit(0), F.lit(2))))
    mixed = F.zip_with("embedding", F.reverse("embedding"), lambda a, b: a + 0.9 * F.col("visit") * b)
    v = v.withColumn("m", mixed).withColumn("n", F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x)))
    start = F.element_at(F.array(F.lit(0), F.lit(60_000_000), F.lit(10_800_000_000)), F.col("visit") + 1)
    return v.select(
        F.concat(F.lit("store_"), F.expr("gid % 4")).alias("store"),
        F.concat(F.lit("camera_"), F.expr("(gid + visit % 2) % 3")).alias("camera_id"),
        F.expr("gid * 3 + visit").alias("track_id"),
        (X.START_US + start + F.col("gid") * 1_500_000 + (F.col("vec_id") % 5) * 400_000).alias("ts_us"),
        F.transform("m", lambda x: x / F.col("n")).alias("embedding"),
        (F.col("quality") / 5).alias("sharpness"),
        F.when(F.col("vec_id") % 7 > 0, F.transform(F.slice("embedding", 1, len(LABELS)), lambda x: F.least(F.lit(1.0), 2 * F.abs(x)))).alias("attributes"),
        F.when(F.col("gid") % 5 > 0, F.transform(F.slice("embedding", 9, 8), lambda x: F.abs(x))).alias("colour"),
    )


@query("v18_online_gallery")
def v18_online(spark, d):
    G.use_rocks(spark)
    path = T.new_folder(spark, "visits")
    rows = visits(spark, d)
    rows.write.parquet(path)
    stream = timed(spark.readStream.schema(rows.schema).parquet(path))
    return T.run_available(G.online_assignment(stream, GALLERY_RULES))


EVENTS = "id string, ts long, camera_id string, reviewed int"


@query("e3_stream_upsert", al.S["e2_event_state"].partition(f"WITH {X.SQL} ")[2])
def e3_stream(spark, d):
    """The change log, a file per sixth of it, through the stream into the table."""
    path = T.new_folder(spark, "events")
    c = al.changes(spark, d)
    most = c.agg(F.max("seq")).first()[0] + 1
    for part in range(6):  # in order: a stream reads files by their time
        c.where(F.expr(f"least(5, seq * 6 div {most}) = {part}")).coalesce(1).write.mode("append").parquet(f"{path}/changes")
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/changes")
    schema = spark.createDataFrame([], EVENTS).schema
    U.upsert_stream(stream, f"{path}/table", f"{path}/state", schema).awaitTermination()
    return U.read_events(spark, f"{path}/table", schema)
