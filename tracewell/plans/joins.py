"""Queries of joins and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.functions import geometry as M
from tracewell.operators import joins as J
from tracewell.operators import sequences as W
from tracewell.operators import traffic as A
from tracewell.plans import traffic as base
from tracewell.sources import adapters as X

AS_OF = base.AS_OF
Q, S = {}, {}

#: (zone_idx, zone, vertices) of every camera in the tests: overlapping, concave, and one without area
ZONES = [
    (0, "window", [(0, 0), (480, 0), (480, 540), (0, 540)]),
    (1, "hall", [(384, 108), (1440, 108), (1440, 864), (960, 432), (384, 864)]),
    (2, "line", [(0, 0), (1920, 1080)]),
    (3, "till", [(1440, 540), (1920, 540), (1920, 1080)]),
]
ZONES_SQL = (
    ", zones AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{z}', [{', '.join(f'[{x}, {y}]' for x, y in v)}])" for i, z, v in ZONES if len(v) >= 3)
    + ") t(zone_idx, zone, v))"
)


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = f"WITH {X.SQL} {sql}"
        return f

    return keep


def zones(spark):
    rows = [(f"camera_{c}", i, z, v) for c in range(1, 6) for i, z, v in ZONES]
    return spark.createDataFrame(rows, "camera_id string, zone_idx int, zone string, vertices array<struct<x:int,y:int>>")


@query(
    "p6_find_zone",
    ZONES_SQL
    + ", e2 AS (SELECT zone_idx, zone, v[i] AS a, v[i % len(v) + 1] AS b FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM zones)), "
    "hit AS (SELECT event_id, zone_idx, zone FROM trk JOIN e2 ON camera_id <> 'camera_6' GROUP BY ALL HAVING bool_or((b[1] - a[1]) * (py - a[2]) = (b[2] - a[2]) * (px - a[1]) AND px BETWEEN least(a[1], b[1]) AND greatest(a[1], b[1]) AND py BETWEEN least(a[2], b[2]) AND greatest(a[2], b[2])) "
    "OR count(*) FILTER ((a[2] > py) <> (b[2] > py) AND px < (b[1] - a[1]) * (py - a[2]) / nullif(b[2] - a[2], 0) + a[1]) % 2 = 1) "
    "SELECT event_id, coalesce(h.zone, 'Unknown') AS zone FROM trk LEFT JOIN (SELECT event_id, min_by(zone, zone_idx) AS zone FROM hit GROUP BY 1) h USING (event_id)",
)
def p6(spark, d):
    return M.find_zone(X.trk(spark, d), zones(spark)).select("event_id", "zone")


@query("p6_zones_by_cell", S["p6_find_zone"].partition(f"WITH {X.SQL} ")[2])
def p6_cells(spark, d):
    return M.find_zone_by_cell(X.trk(spark, d), M.zone_cells(zones(spark))).select("event_id", "zone")


def matrices(spark):
    rows = [(f"camera_{c}", 0.05 * c, 0.001, 3.0, 0.002, 0.04 * c, -2.0, 0.00001, 0.00002, 1.0) for c in range(1, 6)]
    return spark.createDataFrame(rows, "camera_id string, " + ", ".join(f"h{i}{k} double" for i in range(3) for k in range(3)))


@query(
    "p7_to_world",
    ", m AS (SELECT event_id, px, py, CAST(right(camera_id, 1) AS INT) AS c FROM trk) "
    "SELECT event_id, CASE WHEN c < 6 THEN round_even((0.05::DOUBLE * c * px + 0.001::DOUBLE * py + 3) / (0.00001::DOUBLE * px + 0.00002::DOUBLE * py + 1), 2) + 0.0 END AS world_x, "
    "CASE WHEN c < 6 THEN round_even((0.002::DOUBLE * px + 0.04::DOUBLE * c * py - 2) / (0.00001::DOUBLE * px + 0.00002::DOUBLE * py + 1), 2) + 0.0 END AS world_y FROM m",
)
def p7(spark, d):
    return M.to_world(X.trk(spark, d), matrices(spark), "px", "py").select("event_id", "world_x", "world_y")


@query("p8_fit_homography")
def p8(spark, d):
    pairs = M.to_world(X.trk(spark, d), matrices(spark), "px", "py").where("world_x is not null")
    few = pairs.groupBy("camera_id", F.col("k").alias("idx")).agg(F.min(F.struct("event_id", "px", "py", "world_x", "world_y")).alias("p"))
    return M.fit_homography(few.select("camera_id", "idx", F.col("p.px").alias("cx"), F.col("p.py").alias("cy"), F.col("p.world_x").alias("wx"), F.col("p.world_y").alias("wy")))


@query("p9_line_geometry", "SELECT event_id, CAST(1920 * py - 1080 * px AS BIGINT) AS side, round_even(abs(1920 * py - 1080 * px) / sqrt(1920 * 1920 + 1080 * 1080), 6) AS distance FROM trk")
def p9(spark, d):
    line = [F.lit(0), F.lit(0), F.lit(1920), F.lit(1080)]
    return X.trk(spark, d).select("event_id", C.side_of_line("px", "py", *line).cast("long").alias("side"), F.bround(C.distance_to_line("px", "py", *line), 6).alias("distance"))


@query("a13_smooth_density")
def a13(spark, d):
    return M.smooth_density(A.density_grid(X.positions(spark, d), by=["camera_id"]))


@query("p13_filter_detections", "SELECT event_id, (k - j / 2) * 2 AS x1, (k + j / 2) * 2 AS x2 FROM trk WHERE k / 100 > 0.3 AND event_id % 7 <> 0 AND event_id % 5 = 0")
def p13(spark, d):
    from tracewell.operators.vision import filter_detections

    t = X.trk(spark, d)
    score = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("k").cast("double") / 100)
    one = lambda c: F.col(c).cast("double")
    boxes = t.select("event_id", one("k").alias("cx"), one("k").alias("cy"), one("j").alias("w"), one("j").alias("h"), score.alias("score"), (F.col("event_id") % 5).alias("class_id"))
    return filter_detections(boxes, 0.3, F.lit(0.5)).select("event_id", "x1", "x2")


@query("p14_crop_quality_gate", "SELECT event_id FROM tr WHERE x1 >= 96 AND y1 >= 54 AND x2 <= 1824 AND y2 <= 1026 AND (x2 - x1) * (y2 - y1) >= 5000 AND event_id % 10 >= 5")
def p14(spark, d):
    from tracewell.operators.vision import crop_quality_gate

    return crop_quality_gate(X.tracking(spark, d).withColumn("sharpness", (F.col("event_id") % 10).cast("double"))).select("event_id")


@query(
    "p12_age_category",
    "SELECT event_id, CASE WHEN k % 5 = 0 THEN 'young' WHEN k % 3 = 0 THEN 'teenager' WHEN j % 2 = 0 THEN 'senior' WHEN j % 3 = 0 THEN 'adult' "
    "WHEN age = 'young' THEN 'young' WHEN age = 'teenager' THEN 'teenager' WHEN age = 'senior' THEN 'senior' ELSE 'adult' END AS age FROM trk",
)
def p12(spark, d):
    k, j = F.col("k"), F.col("j")
    return X.trk(spark, d).select("event_id", C.age_category(k % 5 == 0, k % 3 == 0, j % 2 == 0, j % 3 == 0, "age").alias("age"))


@query(
    "p11_decode_attributes",
    "SELECT event_id, [CASE WHEN k / 100 > 0.5 THEN 'male' ELSE 'female' END, CASE WHEN j / 100 > 0.5 THEN 'hat' END, CASE WHEN (k + j) % 100 / 100 > 0.5 THEN 'old' END] AS got FROM trk",
)
def p11(spark, d):
    p = F.array(F.col("k") / 100.0, F.col("j") / 100.0, ((F.col("k") + F.col("j")) % 100) / 100.0)
    choices = {"gender": ("female", "male"), "hat": (None, "hat"), "old": ("young", "old")}
    m = C.decode_attributes(F.col("p"), ["gender", "hat", "old"], choices, true_only=["old"])
    return X.trk(spark, d).withColumn("p", p).withColumn("m", m).select("event_id", F.array(F.col("m")["gender"], F.try_element_at("m", F.lit("hat")), F.try_element_at("m", F.lit("old"))).alias("got"))


@query("p10_normalise_zones", "SELECT event_id, list_transform([k, j, k + j], lambda x: round_even(x / 1920, 4)) AS xs FROM trk")
def p10(spark, d):
    z = X.trk(spark, d).withColumn("vertices", F.array(*[F.struct(x.alias("x"), F.lit(0).alias("y")) for x in (F.col("k"), F.col("j"), F.col("k") + F.col("j"))]))
    return M.normalise_zones(z, 1920, 1080).select("event_id", F.transform("vertices", lambda p: p["x"]).alias("xs"))


POINTS = sorted({n for names in C.JOINTS.values() for n in names})


def _xyc(name: str) -> tuple[str, str, str]:
    """Place and confidence of a keypoint, in terms that both engines read alike."""
    i = POINTS.index(name)
    return f"((k * {i + 1} + {3 * i}) % 50)", f"((j * {2 * i + 1} + {7 * i}) % 50)", f"((k + j + {i}) % 10)"


def _angle_sql(names) -> str:
    (ax, ay, a), (bx, by, b), (cx, cy, c) = map(_xyc, names)
    ux, uy, vx, vy = f"({ax} - {bx})", f"({ay} - {by})", f"({cx} - {bx})", f"({cy} - {by})"
    cos = f"(({ux} * {vx} + {uy} * {vy}) / (sqrt({ux} * {ux} + {uy} * {uy}) * sqrt({vx} * {vx} + {vy} * {vy}) + 1e-6::DOUBLE))"
    return f"CASE WHEN least({a}, {b}, {c}) >= 3 THEN round_even(degrees(acos(greatest(-1, least(1, {cos})))), 1) END"


_MID = {part: "(" + " + ".join(_xyc(f"{side}_{part}")[1] for side in ("left", "right")) + ") / 2" for part in ("hip", "knee")}
_SEEN = "least(" + ", ".join(_xyc(f"{side}_{part}")[2] for side in ("left", "right") for part in ("hip", "knee")) + ") >= 3"


@query("p15_joint_angles", "SELECT event_id, " + ", ".join(f"{_angle_sql(n)} AS {joint}" for joint, n in C.JOINTS.items()) + " FROM trk")
def p15(spark, d):
    return X.keypoints(spark, d, {n: _xyc(n) for n in POINTS}).select("event_id", *[C.angle_of("points", joint, 0.3).alias(joint) for joint in C.JOINTS])


@query(
    "p15_posture",
    f"SELECT event_id, CASE WHEN NOT ({_SEEN}) THEN 'unknown' WHEN ({_MID['knee']} - {_MID['hip']}) / greatest({_MID['hip']}, 0.01) < 0.2 THEN 'sitting' "
    f"WHEN ({_MID['knee']} - {_MID['hip']}) / greatest({_MID['hip']}, 0.01) < 0.45 THEN 'crouching' ELSE 'standing' END AS posture FROM trk",
)
def p15_posture(spark, d):
    return X.keypoints(spark, d, {n: _xyc(n) for n in POINTS}).select("event_id", C.posture_of("points", 0.3).alias("posture"))


@query("p19_fire_smoke_flags", "SELECT event_id, CASE WHEN k / 10000 >= 0.003 THEN 'fire' WHEN j / 1000 >= 0.04 THEN 'smoke' END AS kind FROM trk")
def p19(spark, d):
    return X.trk(spark, d).select("event_id", C.fire_smoke(F.col("k") / F.lit(10000.0), F.col("j") / F.lit(1000.0)).alias("kind"))


EVENTS = "(SELECT event_id AS id, camera_id, us // 1000000 AS ts FROM trk WHERE event_type = 'error')"


def errors(spark, d):
    return X.trk(spark, d).where("event_type = 'error'").select(F.col("event_id").alias("id"), "camera_id", F.expr("us div 1000000").alias("ts"))


@query("j1_nearest_frame", f"SELECT e.id, e.camera_id, e.ts, f.ts AS frame_ts, f.path FROM {EVENTS} e JOIN frames f ON f.camera_id = e.camera_id AND f.ts BETWEEN e.ts - 300 AND e.ts + 300 QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY abs(f.ts - e.ts), f.ts) = 1")
def j1(spark, d):
    return J.nearest_frame(errors(spark, d), X.frames(spark, d))


@query("j2_clip_frames", f"SELECT e.id, e.camera_id, e.ts, f.ts AS frame_ts, f.path FROM {EVENTS} e JOIN frames f ON f.camera_id = e.camera_id AND f.ts BETWEEN e.ts - 3600 AND e.ts")
def j2(spark, d):
    return J.clip_frames(errors(spark, d), X.frames(spark, d), 3600)


SEG = (
    ", g AS (SELECT *, CASE WHEN fast_us - lag(fast_us) OVER w > 30000000 THEN 1 ELSE 0 END AS new FROM tr WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY fast_us, event_id)), "
    "n AS (SELECT *, sum(new) OVER (PARTITION BY camera_id, track_id ORDER BY fast_us, event_id) AS s FROM g), "
    "seg AS (SELECT min(event_id) AS seg, camera_id, min(fast_us) AS start_us, max(fast_us) AS end_us, arg_min(x1, event_id) AS sx, arg_min(y2, event_id) AS sy, arg_max(x1, event_id) AS ex, arg_max(y2, event_id) AS ey FROM n GROUP BY camera_id, track_id, s)"
)


def segments(spark, d):
    t = W.segment_tracks(X.tracking(spark, d, "fast_us"))
    ends = lambda f, c: f(c, "event_id")
    return t.groupBy("camera_id", "track_id", "segment_id").agg(
        F.min("event_id").alias("seg"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), ends(F.min_by, "x1").alias("sx"), ends(F.min_by, "y2").alias("sy"), ends(F.max_by, "x1").alias("ex"), ends(F.max_by, "y2").alias("ey")
    )


@query(
    "j3_stitch_candidates",
    SEG + " SELECT n.seg AS new_id, o.seg AS old_id FROM seg n JOIN seg o ON n.camera_id = o.camera_id AND n.seg <> o.seg AND n.start_us - o.end_us > 500000 AND n.start_us - o.end_us < 5000000 AND sqrt((n.sx - o.ex) ** 2 + (n.sy - o.ey) ** 2) < 500",
)
def j3(spark, d):
    return J.stitch_candidates(segments(spark, d), max_gap=5.0).select("new_id", "old_id")


@query("j3_stitch_tracks")
def j3b(spark, d):
    return J.stitch_tracks(segments(spark, d), max_gap=5.0)


@query("j3_inherited_entries")
def j3c(spark, d):
    s = segments(spark, d).withColumn("has_entered", F.col("seg") % 5 == 0)
    return J.inherited(s, J.stitch_tracks(s, max_gap=5.0)).select("seg", "track", "has_entered")


@query("j4_camera_offline", f", p AS (SELECT camera_id, max(fast_us) AS last_us FROM trk WHERE NOT (camera_id = 'camera_2' AND fast_us > {AS_OF - 200_000_000}) AND fast_us <= {AS_OF} GROUP BY 1) SELECT camera_id, last_us FROM p JOIN {base.CAMERAS} c USING (camera_id) WHERE enabled AND {AS_OF} - last_us > 45000000")
def j4(spark, d):
    pings = X.trk(spark, d).select("camera_id", F.col("fast_us").alias("ts_us")).where(F.col("ts_us") <= AS_OF)
    pings = pings.where(~((F.col("camera_id") == "camera_2") & (F.col("ts_us") > AS_OF - 200_000_000)))
    return J.camera_offline(base.cameras(spark, d), pings, AS_OF)


@query("j4_never_seen", f"SELECT camera_id FROM {base.CAMERAS} c WHERE enabled AND camera_id NOT IN (SELECT camera_id FROM trk)")
def j4b(spark, d):
    return J.never_seen(base.cameras(spark, d), X.trk(spark, d))


PAIRS = ", pairs AS (SELECT x.snap, x.person AS a, y.person AS b FROM snaps x JOIN snaps y ON x.snap = y.snap AND x.person < y.person AND (x.world_x - y.world_x) ** 2 + (x.world_y - y.world_y) ** 2 < 40 * 40)"


@query("j5_close_pairs", PAIRS + " SELECT * FROM pairs")
def j5(spark, d):
    return J.close_pairs(X.snapshots(spark, d), 40)


@query("j6_lasting_pairs", PAIRS + ", r AS (SELECT *, snap - row_number() OVER (PARTITION BY a, b ORDER BY snap) AS run FROM pairs) SELECT snap, a, b FROM (SELECT *, min(snap) OVER (PARTITION BY a, b, run) AS s FROM r) WHERE (snap - s) * 5 > 4")
def j6(spark, d):
    return J.lasting_pairs(X.snapshots(spark, d), 40, min_seconds=4)


@query("j6_groups")
def j6b(spark, d):
    return J.groups(X.snapshots(spark, d), 40, min_seconds=4)


@query("j7_recently_active", f"SELECT camera_id, person, max(fast_us) AS last_us FROM tr WHERE fast_us <= {AS_OF} GROUP BY 1, 2 HAVING max(fast_us) >= {AS_OF} - 90000000")
def j7(spark, d):
    return J.recently_active(X.tracking(spark, d, "fast_us"), AS_OF)


@query("j8_join_dimensions", "SELECT event_id, CASE WHEN camera_id <> 'camera_6' THEN 'Cam ' || right(camera_id, 1) END AS camera_name, CASE WHEN camera_id <> 'camera_6' AND zone = 'zone_1_1' THEN 7 END AS zone_idx FROM tr")
def j8(spark, d):
    c = spark.createDataFrame([(f"camera_{i}", f"Cam {i}") for i in range(1, 6)], "camera_id string, name string")
    z = spark.createDataFrame([(f"camera_{i}", "zone_1_1", 7) for i in range(1, 6)], "camera_id string, zone string, zone_idx int")
    return J.join_dimensions(X.tracking(spark, d), c, z).select("event_id", "camera_name", "zone_idx")
