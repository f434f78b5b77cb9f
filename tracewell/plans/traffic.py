"""Queries over the derived retail tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.columns import clean_zone, foot_x, person_id
from tracewell.operators import traffic as A
from tracewell.sources import adapters as X

DAY = "2024-01-15"
LOW = 1_705_276_800_000  # that day, in ms
HIGH = LOW + 86_400_000
AS_OF = X.START_US + 2_500_000_000  # on the fast clock
DAYMS = f"ts >= {LOW} AND ts < {HIGH}"
DAYUS = f"us >= {LOW}000 AND us < {HIGH}000"
ZONE = "CASE WHEN lower(trim(zone)) NOT IN ('', 'unknown', 'none', 'null') THEN trim(zone) END"

Q, S = {}, {}


def query(name: str, sql: str | None = None, head: str = X.SQL):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = f"WITH {head}{sql}" if sql.lstrip().startswith(",") else f"WITH {head} {sql}"
        return f

    return keep


@query("io2_positions", "SELECT id, ts, camera_id, track_id, least(1.0, greatest(0.0, cx * 1.2 - 0.1)) AS cx, least(1.0, greatest(0.0, cy * 1.2 - 0.1)) AS cy FROM positions")
def io2(spark, d):
    from tracewell.sources.logs import clamp_positions

    p = X.positions(spark, d).select("id", "ts", "camera_id", "track_id", (F.col("cx") * 1.2 - 0.1).alias("cx"), (F.col("cy") * 1.2 - 0.1).alias("cy"))
    return clamp_positions(p)


@query("io6_normalise_for_log", "SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(global_id, '') AS global_id, CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END AS has_entered FROM trk")
def io6(spark, d):
    from tracewell.sources.logs import normalise_for_log

    t = X.trk(spark, d).withColumn("has_entered", F.col("event_id") % 3 == 0)
    return normalise_for_log(t, ["event_id", "global_id", "has_entered"])


@query("p1_filter_positions", f"SELECT * FROM positions WHERE camera_id = 'camera_2' AND gender = 'female' AND ts >= {LOW} AND ts <= {HIGH}")
def p1(spark, d):
    return A.filter_positions(X.positions(spark, d), camera="camera_2", gender="female", age="all", as_of=HIGH, to_ts=HIGH)


@query("p2_filter_day", f"SELECT id, ts FROM positions WHERE ts >= {LOW - 86400000} AND ts < {LOW}")
def p2(spark, d):
    return A.filter_day(X.positions(spark, d), DAY, -1).select("id", "ts")


@query("p3_person_id", "SELECT event_id, person FROM tr")
def p3(spark, d):
    return X.tracking(spark, d).select("event_id", person_id().alias("person"))


@query("p4_clean_zone", f"SELECT event_id, {ZONE} AS zone FROM tr")
def p4(spark, d):
    return X.tracking(spark, d).select("event_id", clean_zone().alias("zone"))


@query("p5_foot_point", "SELECT event_id, CAST((x1 + x2) // 2 AS INT) AS fx, y2 AS fy FROM tr")
def p5(spark, d):
    return X.tracking(spark, d).select("event_id", foot_x().alias("fx"), F.col("y2").alias("fy"))


@query("a1_daily_visitors", f"SELECT count(DISTINCT track_id) AS visitors FROM positions WHERE {DAYMS}")
def a1(spark, d):
    return A.daily_visitors(X.positions(spark, d), DAY)


@query("a1_visitors_by_day", "SELECT CAST(make_timestamp(ts * 1000) AS DATE) AS day, count(DISTINCT track_id) AS visitors FROM positions GROUP BY 1")
def a1b(spark, d):
    return A.visitors_by_day(X.positions(spark, d))


@query(
    "a2_hourly_traffic",
    f"SELECT CAST(h AS INT) AS hour, count(DISTINCT track_id) AS visitors FROM range(24) r(h) LEFT JOIN (SELECT * FROM positions WHERE {DAYMS}) p ON (p.ts - {LOW}) // 3600000 = h GROUP BY 1",
)
def a2(spark, d):
    return A.hourly_traffic(X.positions(spark, d), DAY)


HOURS = f"(SELECT CAST((ts - {LOW}) // 3600000 AS INT) AS hour, count(DISTINCT track_id) AS n FROM positions WHERE {DAYMS} GROUP BY 1)"


@query("a3_peak_hour", f"SELECT hour AS peak_hour, n AS visitors FROM {HOURS} ORDER BY n DESC, hour LIMIT 1")
def a3(spark, d):
    return A.peak_hour(X.positions(spark, d), DAY)


@query("a4_last_window_total", f"SELECT count(DISTINCT track_id) AS visitors FROM positions WHERE ts >= {HIGH} - 3600000")
def a4(spark, d):
    return A.last_window_total(X.positions(spark, d), HIGH)


ZONED = f"(SELECT *, {ZONE} AS z, CAST((us - {LOW}000) // 3600000000 AS INT) AS hour FROM tr WHERE {DAYUS})"


@query(
    "a5_zone_hourly",
    f", c AS (SELECT z, hour, count(DISTINCT person) AS n FROM {ZONED} WHERE z IS NOT NULL GROUP BY ALL) "
    "SELECT z AS zone, list(coalesce(n, 0) ORDER BY h) AS hours FROM (SELECT DISTINCT z AS z0 FROM c) CROSS JOIN range(24) r(h) LEFT JOIN c ON z = z0 AND hour = h GROUP BY z0, z HAVING z IS NOT NULL",
)
def a5(spark, d):
    return A.zone_hourly(X.tracking(spark, d), DAY)


S["a5_zone_hourly"] = (
    f"WITH {X.SQL}, c AS (SELECT z, hour, count(DISTINCT person) AS n FROM {ZONED} WHERE z IS NOT NULL GROUP BY ALL) "
    "SELECT z0 AS zone, list(coalesce(n, 0) ORDER BY h) AS hours FROM (SELECT DISTINCT z AS z0 FROM c) CROSS JOIN range(24) r(h) LEFT JOIN c ON z = z0 AND hour = h GROUP BY z0"
)


@query("a6_zone_totals", f"SELECT z AS zone, count(DISTINCT person) AS visitors FROM {ZONED} WHERE z IS NOT NULL GROUP BY z")
def a6(spark, d):
    return A.zone_totals(X.tracking(spark, d), DAY)


@query("a6_top_zone", f"SELECT z AS zone, count(DISTINCT person) AS visitors FROM {ZONED} WHERE z IS NOT NULL GROUP BY z ORDER BY 2 DESC, 1 LIMIT 1")
def a6b(spark, d):
    return A.top_zone(X.tracking(spark, d), DAY)


DWELL = (
    f"(SELECT z, (max(us) - min(us)) / 60000000 AS m FROM {ZONED} WHERE z IS NOT NULL GROUP BY z, person HAVING count(*) >= 2 AND (max(us) - min(us)) / 60000000 BETWEEN 0.17 AND 90)"
)


@query("a7_dwell_by_zone", f"SELECT z AS zone, round_even(avg(m), 1) AS avg_minutes, round_even(list_sort(list(m))[len(list(m)) // 2 + 1], 1) AS median_minutes, count(*) AS visits FROM {DWELL} GROUP BY z")
def a7(spark, d):
    return A.dwell_by_zone(X.tracking(spark, d), DAY)


for _name, _column in (("gender", "gender"), ("age", "age_group")):
    query(f"a8_{_name}_split", f"SELECT {_column}, count(DISTINCT track_id || '_' || camera_id) AS visitors FROM positions WHERE ts >= {LOW} AND ts <= {HIGH} GROUP BY 1")(
        lambda spark, d, c=_column: A.split(X.positions(spark, d), DAY, c)
    )


@query(
    "a9_net_visitors",
    f"SELECT count(*) FILTER (event_type = 'entry') AS entries, count(*) FILTER (event_type = 'exit') AS exits, greatest(0, count(*) FILTER (event_type = 'entry') - count(*) FILTER (event_type = 'exit')) AS net FROM occ WHERE {DAYUS}",
)
def a9(spark, d):
    return A.net_visitors(X.occupancy_log(spark, d), DAY)


@query(
    "a9_entry_peak_hour",
    f"SELECT lpad(CAST(h AS VARCHAR), 2, '0') || ':00–' || lpad(CAST((h + 1) % 24 AS VARCHAR), 2, '0') || ':00' AS label, n AS entries FROM (SELECT (us - {LOW}000) // 3600000000 AS h, count(*) AS n, min(us) AS seen FROM occ WHERE {DAYUS} AND event_type = 'entry' GROUP BY 1) ORDER BY n DESC, seen LIMIT 1",
)
def a9b(spark, d):
    return A.entry_peak_hour(X.occupancy_log(spark, d), DAY)


@query("a10_recent_entries", f"SELECT track_id, camera_id, fast_us AS ts_us FROM occ WHERE event_type = 'entry' AND fast_us BETWEEN {AS_OF} - 120000000 AND {AS_OF}")
def a10(spark, d):
    return A.recent_entries(X.occupancy_log(spark, d, "fast_us"), AS_OF)


@query(
    "a11_compare_days",
    f", c AS (SELECT count(DISTINCT track_id) FILTER (ts >= {LOW}) AS t, count(DISTINCT track_id) FILTER (ts < {LOW}) AS y FROM positions WHERE ts >= {LOW - 86400000} AND ts < {HIGH}) "
    "SELECT t AS today, y AS yesterday, t - y AS diff, CASE WHEN y <> 0 THEN round_even((t - y) / y * 100, 1) END AS vs_yesterday_pct, CAST(floor(abs(t - y) / greatest(y, 1) * 100) AS INT) AS trend_pct, CASE WHEN t >= y THEN 'up' ELSE 'down' END AS trend FROM c",
)
def a11(spark, d):
    return A.compare_days(X.positions(spark, d), DAY)


@query("a12_density_grid", "SELECT CAST(least(trunc(cx * 320), 319) AS INT) AS bx, CAST(least(trunc(cy * 180), 179) AS INT) AS by, count(*) AS n FROM positions GROUP BY 1, 2")
def a12(spark, d):
    return A.density_grid(X.positions(spark, d))


def last_rows(seconds: int) -> str:
    return f"(SELECT person, max_by(camera_id, event_id) AS camera_id, max_by(zone, event_id) AS zone, max_by(gender, event_id) AS gender, max(fast_us) AS fast_us FROM tr WHERE fast_us BETWEEN {AS_OF} - {seconds}000000 AND {AS_OF} GROUP BY person)"


@query("a14_live_occupancy_camera", f"SELECT camera_id, count(*) AS persons FROM {last_rows(8)} GROUP BY 1")
def a14(spark, d):
    return A.live_occupancy(X.tracking(spark, d, "fast_us"), AS_OF)


@query("a14_live_occupancy_zone", f", z AS (SELECT coalesce({ZONE}, 'Unknown') AS zone, count(*) AS persons FROM {last_rows(30)} GROUP BY 1) SELECT zone, persons, CAST(round_even(100 * persons / sum(persons) OVER (), 0) AS INT) AS pct FROM z")
def a14b(spark, d):
    return A.live_occupancy(X.tracking(spark, d, "fast_us"), AS_OF, 30, "zone")


CAMERAS = "(SELECT DISTINCT camera_id, camera_id <> 'camera_3' AS enabled FROM trk UNION ALL SELECT 'camera_9', true)"


def cameras(spark, d):
    known = X.trk(spark, d).select("camera_id").distinct()
    return known.withColumn("enabled", F.col("camera_id") != "camera_3").union(spark.createDataFrame([("camera_9", True)], "camera_id string, enabled boolean"))


@query(
    "a15_store_overview",
    f", o AS (SELECT c.camera_id, count(l.person) AS persons FROM {CAMERAS} c LEFT JOIN {last_rows(12)} l USING (camera_id) WHERE enabled GROUP BY 1) SELECT * FROM o UNION ALL SELECT 'total', CAST(sum(persons) AS BIGINT) FROM o",
)
def a15(spark, d):
    return A.store_overview(X.tracking(spark, d, "fast_us"), cameras(spark, d), AS_OF)


@query(
    "a16_fleet_health",
    ", h AS (SELECT user_id % 20 AS device, camera_id, max_by(k % 30, event_id) AS fps FROM trk GROUP BY ALL) SELECT device, count(*) FILTER (fps > 0) AS cameras_active, coalesce(round_even(avg(fps) FILTER (fps > 0), 1), 0.0) AS fps_avg FROM h GROUP BY 1",
)
def a16(spark, d):
    t = X.trk(spark, d).select((F.col("user_id") % 20).alias("device"), "camera_id", (F.col("k") % 30).cast("double").alias("fps"), F.col("event_id").alias("ts"))
    return A.fleet_health(t)


@query("a16_camera_status", "SELECT user_id % 20 AS device, camera_id, max_by(k % 30, event_id) > 0 AS active, printf('%.1f', max_by(k % 30, event_id)::DOUBLE) AS fps FROM trk GROUP BY ALL")
def a16_status(spark, d):
    t = X.trk(spark, d).select((F.col("user_id") % 20).alias("device"), "camera_id", (F.col("k") % 30).cast("double").alias("fps"), F.col("event_id").alias("ts"))
    return A.camera_status(t)


@query("a17_job_metrics", "SELECT event_type AS status, count(*) AS jobs, round_even(avg(value), 2) AS avg_ms, max(value) AS max_ms, min(value) AS min_ms FROM trk GROUP BY 1")
def a17(spark, d):
    return A.job_metrics(X.trk(spark, d).select(F.col("event_type").alias("status"), F.col("value").alias("inference_ms")))


@query("a18_clip_stats", "SELECT track_id, count(*) AS frames, (max(fast_us) - min(fast_us)) / 1e6 AS seconds FROM tr GROUP BY 1")
def a18(spark, d):
    return A.clip_stats(X.tracking(spark, d, "fast_us"))


@query("a18_clip_summary", "SELECT count(*) AS tracks, CAST(sum(n) AS BIGINT) AS frames, round_even(avg(s), 2) AS avg_seconds FROM (SELECT count(*) AS n, (max(fast_us) - min(fast_us)) / 1e6 AS s FROM tr GROUP BY track_id)")
def a18b(spark, d):
    return A.clip_summary(X.tracking(spark, d, "fast_us"))


@query(
    "a19_first_zone",
    f", f AS (SELECT camera_id, track_id, min_by(zone, event_id) AS zone, min(fast_us) AS ts_us, min_by(gender, event_id) AS gender, min_by(age_category, event_id) AS age_category FROM tr WHERE {ZONE} IS NOT NULL GROUP BY ALL) "
    "SELECT f.*, coalesce((ts_us - (SELECT max(fast_us) FROM occ o WHERE o.event_type = 'entry' AND o.camera_id = f.camera_id AND o.track_id = f.track_id AND o.fast_us <= ts_us)) // 1000000, 0) AS seconds FROM f",
)
def a19(spark, d):
    return A.first_zone(X.tracking(spark, d, "fast_us"), X.occupancy_log(spark, d, "fast_us"))


@query(
    "a20_ops_notifications",
    ", p AS (SELECT person, max_by(CASE WHEN event_type = 'purchase' THEN 'Checkout 1' ELSE 'hall' END, trk.event_id) AS zone, max_by(age, trk.event_id) AS age, count(*) AS n FROM trk JOIN tr USING (event_id) GROUP BY 1) "
    ", c AS (SELECT count(*) FILTER (zone ILIKE '%checkout%') AS q, count(*) FILTER (n > 60) AS l, count(*) FILTER (age = 'teenager') AS t, count(*) AS n FROM p) "
    "SELECT rule, n FROM (SELECT 'queue' AS rule, q AS n, q >= 3 AS f FROM c UNION ALL SELECT 'long_dwell', l, l > 0 FROM c UNION ALL SELECT 'teen_group', t, t >= 3 AND t >= 0.4 * n FROM c) WHERE f",
)
def a20(spark, d):
    t = X.trk(spark, d).withColumn("person", person_id()).withColumn("zone", F.when(F.col("event_type") == "purchase", "Checkout 1").otherwise("hall"))
    people = t.groupBy("person").agg(F.max_by("zone", "event_id").alias("zone"), F.max_by("age", "event_id").alias("age"), F.count("*").alias("detection_count"))
    return A.ops_notifications(people, long_rows=60)


@query(
    "w1_busiest_window",
    f", p AS (SELECT ts FROM positions WHERE {DAYMS}), w AS (SELECT ts, count(*) OVER f AS n, min(ts) OVER f AS s FROM p WINDOW f AS (ORDER BY ts RANGE BETWEEN 1800000 PRECEDING AND CURRENT ROW)) "
    "SELECT strftime(make_timestamp(s * 1000), '%H:%M') AS \"start\", strftime(make_timestamp((s + 1800000) * 1000), '%H:%M') AS \"end\", n AS rows FROM w ORDER BY n DESC, ts LIMIT 1",
)
def w1(spark, d):
    return A.busiest_window(X.positions(spark, d), DAY)


@query("a21_dashboard")
def a21(spark, d):
    return A.dashboard(X.positions(spark, d), X.tracking(spark, d), DAY)
