"""Queries of the order-dependent jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.columns import person_id
from tracewell.operators import gates as G
from tracewell.operators import sequences as W
from tracewell.plans import traffic as base
from tracewell.sources import adapters as X

AS_OF = base.AS_OF
Q, S = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = f"WITH {X.SQL} {sql}"
        return f

    return keep


def lines(spark):
    return spark.createDataFrame([(f"camera_{i}", 960, 0, 960, 1080, "left" if i % 2 else "right") for i in range(1, 7)], "camera_id string, x1 int, y1 int, x2 int, y2 int, inside_direction string")


@query(
    "w2_line_crossings",
    ", p AS (SELECT *, CAST((x1 + x2) // 2 AS INT) AS fx, lag(CAST((x1 + x2) // 2 AS INT)) OVER w AS px, y2 AS fy, lag(y2) OVER w AS py FROM tr WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY fast_us, event_id)), "
    "s AS (SELECT *, CASE WHEN CAST(right(camera_id, 1) AS INT) % 2 = 1 THEN 960 - fx >= 0 ELSE fx - 960 >= 0 END AS now, CASE WHEN CAST(right(camera_id, 1) AS INT) % 2 = 1 THEN 960 - px >= 0 ELSE px - 960 >= 0 END AS was FROM p WHERE px IS NOT NULL) "
    "SELECT camera_id, track_id, fast_us AS ts_us, event_id, CASE WHEN now THEN 'entry' ELSE 'exit' END AS kind FROM s WHERE now <> was AND fx <> px AND least(fx, px) <= 960 AND greatest(fx, px) >= 960",
)
def w2(spark, d):
    return W.line_crossings(X.tracking(spark, d, "fast_us"), lines(spark))


@query("w2_gated_crossings")
def w2g(spark, d):
    return G.gate_crossings(W.line_crossings(X.tracking(spark, d, "fast_us"), lines(spark)))


@query("w3_smooth_positions")
def w3(spark, d):
    t = X.tracking(spark, d, "fast_us").withColumn("fx", F.expr("(x1 + x2) div 2"))
    return G.smooth(t.select("camera_id", "track_id", "ts_us", "event_id", "fx", "y2"), ["camera_id", "track_id"], ["ts_us", "event_id"], ["fx", "y2"])


@query(
    "w4_sample_positions",
    "SELECT camera_id, track_id, fast_us AS ts_us, ((x1 + x2) // 2) / 1920 AS cx, y2 / 1080 AS cy FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY fast_us, event_id) AS n FROM tr) WHERE n % 5 = 0",
)
def w4(spark, d):
    return W.sample_positions(X.tracking(spark, d, "fast_us"))


STOPS = (
    ", r AS (SELECT *, CASE WHEN lag(zone) OVER w IS DISTINCT FROM zone THEN 1 ELSE 0 END AS new FROM tr WINDOW w AS (PARTITION BY person ORDER BY fast_us, event_id)), "
    "i AS (SELECT *, sum(new) OVER (PARTITION BY person ORDER BY fast_us, event_id) AS stop FROM r), "
    "g AS (SELECT person, stop, zone, min(fast_us) AS entry_us, arg_max(camera_id, event_id) AS cam FROM i GROUP BY ALL), "
    "stops AS (SELECT *, lead(entry_us) OVER (PARTITION BY person ORDER BY stop) AS exit_us FROM g)"
)


@query("w5_zone_trail", STOPS + " SELECT person, zone, cam, entry_us, exit_us FROM stops QUALIFY exit_us IS NULL OR row_number() OVER (PARTITION BY person, exit_us IS NULL ORDER BY stop DESC) <= 10")
def w5(spark, d):
    return W.zone_trail(X.tracking(spark, d, "fast_us"))


@query("w7_time_in_zone", STOPS.replace("FROM tr WINDOW", f"FROM (SELECT * FROM tr WHERE fast_us <= {AS_OF}) WINDOW") + f" SELECT person, zone, entry_us, ({AS_OF} - entry_us) // 1000000 AS seconds FROM stops WHERE exit_us IS NULL")
def w7(spark, d):
    return W.time_in_zone(X.tracking(spark, d, "fast_us"), AS_OF)


PATHS = (
    ", t AS (SELECT track_id, list({'cx': cx, 'cy': cy} ORDER BY ts, id) AS p FROM positions GROUP BY 1 HAVING count(*) >= 6), "
    "s AS (SELECT track_id, CASE WHEN len(p) <= 10 THEN p ELSE list_transform(range(10), lambda i: p[CAST(floor(i * (len(p) / 10)) AS INT) + 1]) END AS p FROM t), "
    "k AS (SELECT track_id, p, CAST(trunc(p[1].cx * 10) AS INT) || ',' || CAST(trunc(p[1].cy * 10) AS INT) || '>' || CAST(trunc(p[-1].cx * 10) AS INT) || ',' || CAST(trunc(p[-1].cy * 10) AS INT) AS cluster FROM s), "
    "m AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY track_id) - 1 AS i, count(*) OVER (PARTITION BY cluster) AS size, min(track_id) OVER (PARTITION BY cluster) AS first FROM k) "
    "SELECT cluster, size, first, list_transform(p, lambda q: {'cx': round_even(q.cx, 3), 'cy': round_even(q.cy, 3)}) AS path FROM m WHERE i = size // 2 ORDER BY size DESC, first LIMIT 5"
)


@query("w8_common_paths", PATHS)
def w8(spark, d):
    return W.common_paths(X.positions(spark, d))


@query("w9_even_sample", ", n AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY camera_id) AS n FROM frames) SELECT camera_id, ts, path FROM n WHERE n <= 8 OR list_contains(list_transform(range(8), lambda j: (j * n) // 8), i)")
def w9(spark, d):
    return W.even_sample(X.frames(spark, d), ["camera_id"], ["ts"], 8)


@query("w9_keyframes", ", n AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY camera_id) AS n FROM frames) SELECT camera_id, ts, path FROM n WHERE n <= 3 OR list_contains(list_transform(range(3), lambda j: CAST(round_even(j * (n - 1) / 2, 0) AS BIGINT)), i)")
def w9b(spark, d):
    return W.keyframes(X.frames(spark, d), ["camera_id"], ["ts"], 3)


@query("w10_throttle")
def w10(spark, d):
    return G.throttle(X.trk(spark, d).select("camera_id", "fast_us", "event_id"), ["camera_id"], "fast_us", 1e6, ["event_id"])


@query(
    "w11_dedupe_live_tracks",
    f"SELECT global_id, camera_id, track_id, ts_us, event_id, detection_count FROM (SELECT global_id, camera_id, track_id, fast_us AS ts_us, event_id, k AS detection_count FROM trk WHERE fast_us > {AS_OF} - 50000000 AND fast_us <= {AS_OF} AND global_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY global_id ORDER BY detection_count DESC, ts_us, event_id) = 1",
)
def w11(spark, d):
    t = X.trk(spark, d).select("global_id", "camera_id", "track_id", F.col("fast_us").alias("ts_us"), "event_id", F.col("k").alias("detection_count"))
    return W.dedupe_live_tracks(t, AS_OF, 50)


@query("w12_people_gallery", f"SELECT person, camera_id, zone, fast_us AS ts_us, {AS_OF} - fast_us < 5000000 AS active FROM {base.last_rows(120)}")
def w12(spark, d):
    return W.people_gallery(X.tracking(spark, d, "fast_us"), AS_OF)


@query(
    "w13_best_crops",
    ", c AS (SELECT person, tr.fast_us AS ts_us, event_id, CAST(k AS DOUBLE) AS sharpness FROM tr JOIN trk USING (event_id)), "
    "n AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY person ORDER BY ts_us, event_id) > 60000000 THEN 1 ELSE 0 END AS new FROM c), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY person ORDER BY ts_us, event_id) AS s FROM n), l AS (SELECT *, max(s) OVER (PARTITION BY person) AS l FROM s) "
    "SELECT person, ts_us, event_id, sharpness, CAST(row_number() OVER (PARTITION BY person ORDER BY sharpness DESC, ts_us, event_id) AS INT) AS rank FROM l WHERE s = l QUALIFY rank <= 3",
)
def w13(spark, d):
    c = X.trk(spark, d).select(person_id().alias("person"), F.col("fast_us").alias("ts_us"), "event_id", F.col("k").cast("double").alias("sharpness"))
    return W.best_crops(c, gap=60)


@query(
    "w14_recent_history",
    ", c AS (SELECT conv_id AS session, turn AS seq, role, text, lead(role) OVER w AS r, lead(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
    "p AS (SELECT * FROM c WHERE role = 'user' AND r = 'assistant' QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 6) "
    "SELECT session, flatten(list([{'role': 'user', 'text': text}, {'role': 'assistant', 'text': t}] ORDER BY seq)) AS history FROM p GROUP BY 1",
)
def w14(spark, d):
    return W.recent_history(X.chat(spark, d))


@query(
    "w15_segment_tracks",
    ", s AS (SELECT *, CASE WHEN fast_us - lag(fast_us) OVER w > 300000000 THEN 1 ELSE 0 END AS new FROM tr WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY fast_us, event_id)) "
    "SELECT event_id, CAST(sum(new) OVER (PARTITION BY camera_id, track_id ORDER BY fast_us, event_id) AS BIGINT) AS segment_id FROM s",
)
def w15(spark, d):
    return W.segment_tracks(X.tracking(spark, d, "fast_us"), gap=300).select("event_id", "segment_id")
