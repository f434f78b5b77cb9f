"""Queries over several stores whose ids collide: the jobs of one store with `by`, and their SQL with the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.columns import person_id
from tracewell.operators import alerts as E
from tracewell.operators import gates as G
from tracewell.operators import joins as J
from tracewell.operators import sequences as W
from tracewell.operators import traffic as A
from tracewell.plans import sequences as seq
from tracewell.plans import traffic as base
from tracewell.sources import adapters as X

AS_OF = base.AS_OF
BY = ["store_id"]
Q, S = {}, {}
#: `tr`, `trk` and `occ` with their store.
HEAD = X.SQL + f", ft AS (SELECT *, {X.STORE_SQL} AS store_id FROM tr), fk AS (SELECT *, {X.STORE_SQL} AS store_id FROM trk), fo AS (SELECT *, {X.STORE_SQL} AS store_id FROM occ)"


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = f"WITH {HEAD} {sql}"
        return f

    return keep


def tracking(spark, d):
    return X.in_stores(X.tracking(spark, d, "fast_us"))


def log(spark, d):
    return X.in_stores(X.occupancy_log(spark, d, "fast_us"))


def in_store(sql: str) -> str:
    """SQL of one store, its persons and tracks told apart by store."""
    return (
        sql.replace("FROM tr ", "FROM ft ")
        .replace("PARTITION BY person", "PARTITION BY store_id, person")
        .replace("SELECT person, stop", "SELECT store_id, person, stop")
        .replace("SELECT person,", "SELECT store_id, person,")
        .replace("PARTITION BY camera_id, track_id", "PARTITION BY store_id, camera_id, track_id")
    )


STOPS = in_store(seq.STOPS)


@query("w2_fleet_crossings", in_store(seq.S["w2_line_crossings"].partition(f"WITH {X.SQL} ")[2]).replace("SELECT camera_id, track_id, fast_us AS", "SELECT store_id, camera_id, track_id, fast_us AS"))
def w2(spark, d):
    lines = seq.lines(spark).withColumn("store_id", F.explode(F.array(F.lit("store_0"), F.lit("store_1"))))
    return W.line_crossings(tracking(spark, d), lines, BY)


@query("w4_fleet_samples", in_store(seq.S["w4_sample_positions"].partition(f"WITH {X.SQL} ")[2]).replace("SELECT camera_id", "SELECT store_id, camera_id").replace("FROM tr)", "FROM ft)"))
def w4(spark, d):
    return W.sample_positions(tracking(spark, d), by=BY)


@query("w5_fleet_trail", STOPS + " SELECT store_id, person, zone, cam, entry_us, exit_us FROM stops QUALIFY exit_us IS NULL OR row_number() OVER (PARTITION BY store_id, person, exit_us IS NULL ORDER BY stop DESC) <= 10")
def w5(spark, d):
    return W.zone_trail(tracking(spark, d), by=BY)


@query("w7_fleet_time_in_zone", STOPS.replace("FROM ft WINDOW", f"FROM (SELECT * FROM ft WHERE fast_us <= {AS_OF}) WINDOW") + f" SELECT store_id, person, zone, entry_us, ({AS_OF} - entry_us) // 1000000 AS seconds FROM stops WHERE exit_us IS NULL")
def w7(spark, d):
    return W.time_in_zone(tracking(spark, d), AS_OF, BY)


@query(
    "w11_fleet_live_tracks",
    f"SELECT store_id, global_id, camera_id, track_id, fast_us AS ts_us, event_id, k AS detection_count FROM fk WHERE fast_us > {AS_OF} - 50000000 AND fast_us <= {AS_OF} AND global_id IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY store_id, global_id ORDER BY k DESC, fast_us, event_id) = 1",
)
def w11(spark, d):
    t = X.in_stores(X.trk(spark, d)).select("store_id", "global_id", "camera_id", "track_id", F.col("fast_us").alias("ts_us"), "event_id", F.col("k").alias("detection_count"))
    return W.dedupe_live_tracks(t, AS_OF, 50, BY)


@query(
    "w12_fleet_gallery",
    f"SELECT store_id, person, camera_id, zone, fast_us AS ts_us, {AS_OF} - fast_us < 5000000 AS active FROM ft WHERE fast_us BETWEEN {AS_OF} - 120000000 AND {AS_OF} "
    "QUALIFY row_number() OVER (PARTITION BY store_id, person ORDER BY fast_us DESC, event_id DESC) = 1",
)
def w12(spark, d):
    return W.people_gallery(tracking(spark, d), AS_OF, by=BY)


@query(
    "w13_fleet_crops",
    ", c AS (SELECT store_id, coalesce(nullif(global_id, ''), camera_id || '_' || track_id) AS person, fast_us AS ts_us, event_id, CAST(k AS DOUBLE) AS sharpness FROM fk), "
    "n AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY store_id, person ORDER BY ts_us, event_id) > 60000000 THEN 1 ELSE 0 END AS new FROM c), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY store_id, person ORDER BY ts_us, event_id) AS s FROM n), l AS (SELECT *, max(s) OVER (PARTITION BY store_id, person) AS l FROM s) "
    "SELECT store_id, person, ts_us, event_id, sharpness, CAST(row_number() OVER (PARTITION BY store_id, person ORDER BY sharpness DESC, ts_us, event_id) AS INT) AS rank FROM l WHERE s = l QUALIFY rank <= 3",
)
def w13(spark, d):
    c = X.in_stores(X.trk(spark, d)).select("store_id", person_id().alias("person"), F.col("fast_us").alias("ts_us"), "event_id", F.col("k").cast("double").alias("sharpness"))
    return W.best_crops(c, gap=60, by=BY)


@query(
    "w15_fleet_segments",
    ", s AS (SELECT *, CASE WHEN fast_us - lag(fast_us) OVER w > 300000000 THEN 1 ELSE 0 END AS new FROM ft WINDOW w AS (PARTITION BY store_id, camera_id, track_id ORDER BY fast_us, event_id)) "
    "SELECT event_id, CAST(sum(new) OVER (PARTITION BY store_id, camera_id, track_id ORDER BY fast_us, event_id) AS BIGINT) AS segment_id FROM s",
)
def w15(spark, d):
    return W.segment_tracks(tracking(spark, d), 300, [*BY, *W.TRACK]).select("event_id", "segment_id")


PRESENT = (
    ", c AS (SELECT store_id, person, camera_id, fast_us, event_id, unnest(generate_series((fast_us + 4999999) // 5000000, (fast_us + 11999999) // 5000000)) AS tick FROM ft), "
    "p AS (SELECT store_id, tick, person, arg_max(camera_id, event_id) AS camera_id FROM c WHERE tick * 5000000 - fast_us < 12000000 GROUP BY ALL) "
)


@query("al1_fleet_queues", PRESENT + "SELECT store_id, 'queue' AS type, '' AS entity, tick * 5000000 AS ts_us, camera_id, count(*) AS value FROM p GROUP BY store_id, tick, camera_id HAVING count(*) >= 4")
def al1(spark, d):
    return E.queue_alerts(tracking(spark, d), 4, BY)


@query("al2_fleet_capacity", PRESENT + "SELECT store_id, 'capacity' AS type, '' AS entity, tick * 5000000 AS ts_us, '' AS camera_id, count(*) AS value FROM p GROUP BY store_id, tick HAVING count(*) >= 12")
def al2(spark, d):
    return E.capacity_alerts(tracking(spark, d), 12, BY)


def _dwell(kind: str, minutes: int, entity: str) -> str:
    return STOPS + (
        ", x AS (SELECT store_id, person, camera_id, fast_us, min(fast_us) OVER (PARTITION BY store_id, person, stop) AS entry_us, "
        "least(coalesce(lead(fast_us) OVER (PARTITION BY store_id, person ORDER BY fast_us, event_id) - 1, fast_us + 11999999), fast_us + 11999999) AS until FROM i), "
        f"t AS (SELECT *, unnest(generate_series((greatest(fast_us, entry_us + {minutes * 60_000_000}) + 4999999) // 5000000, until // 5000000)) AS tick FROM x) "
        f"SELECT store_id, '{kind}' AS type, {entity} AS entity, tick * 5000000 AS ts_us, camera_id, (tick * 5000000 - entry_us) // 60000000 AS value FROM t"
    )


@query("al3_fleet_dwell", _dwell("dwell", 5, "person"))
def al3(spark, d):
    return E.dwell_alerts(tracking(spark, d), by=BY)


@query("al4_fleet_loitering", _dwell("loitering", 10, "'loiter_' || person"))
def al4(spark, d):
    return E.loitering_alerts(tracking(spark, d), by=BY)


@query("al5_fleet_surges", ", s AS (SELECT store_id, unnest(generate_series((fast_us + 4999999) // 5000000, (fast_us + 4999999) // 5000000 + 23)) AS tick FROM fo WHERE event_type = 'entry') SELECT store_id, 'surge' AS type, '' AS entity, tick * 5000000 AS ts_us, '' AS camera_id, count(*) AS value FROM s GROUP BY store_id, tick HAVING count(*) >= 8")
def al5(spark, d):
    return E.surge_alerts(log(spark, d), least=8, by=BY)


@query("al7_fleet_cooldown")
def al7(spark, d):
    t = tracking(spark, d)
    both = E.queue_alerts(t, 4, BY).unionByName(E.dwell_alerts(t, by=BY)).unionByName(E.surge_alerts(log(spark, d), least=8, by=BY))
    return G.apply_cooldown(both.drop("value"), E.COOLDOWNS, BY)


SNAPS = (
    ", fs AS (SELECT store_id, fast_us // 5000000 AS snap, user_id AS person, max_by(k, event_id) AS x, max_by(j, event_id) AS y FROM fk GROUP BY ALL), "
    "cp AS (SELECT a.store_id, a.snap, a.person AS a, b.person AS b FROM fs a JOIN fs b ON a.store_id = b.store_id AND a.snap = b.snap AND a.person < b.person WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 900) "
)


def snapshots(spark, d):
    t = X.in_stores(X.trk(spark, d)).withColumn("snap", F.expr("fast_us div 5000000"))
    last = t.groupBy("store_id", "snap", "user_id").agg(F.max_by(F.struct("k", "j"), "event_id").alias("r"))
    return last.select("store_id", "snap", F.col("user_id").alias("person"), F.col("r.k").alias("world_x"), F.col("r.j").alias("world_y"))


@query("j5_fleet_close_pairs", SNAPS + "SELECT * FROM cp")
def j5(spark, d):
    return J.close_pairs(snapshots(spark, d), 30, BY)


@query(
    "j6_fleet_lasting_pairs",
    SNAPS + ", n AS (SELECT *, snap - row_number() OVER (PARTITION BY store_id, a, b ORDER BY snap) AS run FROM cp), m AS (SELECT *, min(snap) OVER (PARTITION BY store_id, a, b, run) AS since FROM n) "
    "SELECT store_id, snap, a, b FROM m WHERE (snap - since) * 5 >= 5",
)
def j6(spark, d):
    return J.lasting_pairs(snapshots(spark, d), 30, min_seconds=4.9, by=BY)


@query("j7_fleet_active", f"SELECT store_id, camera_id, person, max(fast_us) AS last_us FROM ft WHERE fast_us <= {AS_OF} GROUP BY ALL HAVING max(fast_us) >= {AS_OF} - 90000000")
def j7(spark, d):
    return J.recently_active(tracking(spark, d), AS_OF, by=BY)


@query("a10_fleet_entries", f"SELECT store_id, track_id, camera_id, fast_us AS ts_us FROM fo WHERE event_type = 'entry' AND fast_us BETWEEN {AS_OF} - 120000000 AND {AS_OF}")
def a10(spark, d):
    return A.recent_entries(log(spark, d), AS_OF, by=BY)


@query(
    "a15_fleet_overview",
    f", l AS (SELECT store_id, person, arg_max(camera_id, event_id) AS camera_id FROM ft WHERE fast_us BETWEEN {AS_OF} - 12000000 AND {AS_OF} GROUP BY ALL), "
    "c AS (SELECT s.store_id, c.camera_id FROM (VALUES ('store_0'), ('store_1')) s(store_id), (SELECT DISTINCT camera_id FROM trk) c), "
    "n AS (SELECT c.store_id, c.camera_id, count(l.person) AS persons FROM c LEFT JOIN l USING (store_id, camera_id) GROUP BY ALL) "
    "SELECT * FROM n UNION ALL SELECT store_id, 'total', CAST(sum(persons) AS BIGINT) FROM n GROUP BY store_id",
)
def a15(spark, d):
    cameras = X.trk(spark, d).select("camera_id").distinct().withColumn("enabled", F.lit(True)).withColumn("store_id", F.explode(F.array(F.lit("store_0"), F.lit("store_1"))))
    return A.store_overview(tracking(spark, d), cameras, AS_OF, by=BY)


@query(
    "a19_fleet_first_zone",
    ", z AS (SELECT * FROM ft WHERE lower(trim(zone)) NOT IN ('', 'unknown', 'none', 'null') QUALIFY row_number() OVER (PARTITION BY store_id, camera_id, track_id ORDER BY fast_us, event_id) = 1) "
    "SELECT z.store_id, z.camera_id, z.track_id, z.zone, z.fast_us AS ts_us, z.gender, z.age_category, coalesce((z.fast_us - max(o.fast_us)) // 1000000, 0) AS seconds "
    "FROM z LEFT JOIN fo o ON o.store_id = z.store_id AND o.camera_id = z.camera_id AND o.track_id = z.track_id AND o.event_type = 'entry' AND o.fast_us <= z.fast_us GROUP BY z.store_id, z.camera_id, z.track_id, z.zone, z.fast_us, z.gender, z.age_category",
)
def a19(spark, d):
    return A.first_zone(tracking(spark, d), log(spark, d), BY)
