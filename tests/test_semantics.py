"""Edges that the derived tables don't reach, and replays of the sequential folds."""

import numpy as np
from pyspark.sql import functions as F
from tracewell.functions import columns as C
from tracewell.functions import geometry as M
from tracewell.functions import questions
from tracewell.operators import gates as G
from tracewell.operators import identity as V
from tracewell.operators import joins as J
from tracewell.operators import traffic as A
from tracewell.operators import sequences as W
from tracewell.operators import alerts as E
from tracewell.plans import sequences as seq
from tracewell.plans import streams
from tracewell.sources import adapters as X
from tracewell.sources import logs

SF = "/root/testdata/sf0.001"
LOW, HIGH = A.day_bounds_ms("2024-01-15")


def positions(spark, rows):
    return spark.createDataFrame(rows, "id long, ts long, camera_id string, track_id long, cx double, cy double, gender string, age_group string")


def test_day_is_half_open_for_totals_and_closed_for_splits(spark):
    p = positions(spark, [(1, LOW, "a", 1, 0.0, 0.0, "male", "adult"), (2, HIGH, "a", 2, 0.0, 0.0, "male", "adult"), (3, LOW, "b", 1, 0.0, 0.0, "male", "adult")])
    assert A.daily_visitors(p, "2024-01-15").first()[0] == 1  # ids collide across cameras
    assert A.daily_visitors(p, "2024-01-15", key="camera_track").first()[0] == 2
    assert A.gender_split(p, "2024-01-15").first()["visitors"] == 3


def test_empty_inputs(spark):
    p = positions(spark, [])
    assert A.peak_hour(p, "2024-01-15").collect() == [(None, 0)]
    assert sum(r.visitors for r in A.hourly_traffic(p, "2024-01-15").collect()) == 0
    assert A.busiest_window(p, "2024-01-15").count() == 0
    assert A.compare_days(p, "2024-01-15").first().vs_yesterday_pct is None


def test_local_days_follow_the_zone(spark):
    assert A.day_bounds_ms("2024-01-15", tz="America/Sao_Paulo")[0] == LOW + 3 * 3_600_000
    p = positions(spark, [(1, LOW, "a", 1, 0.0, 0.0, "m", "a")])
    assert str(A.visitors_by_day(p, tz="America/Sao_Paulo").first()["day"]) == "2024-01-14"


def test_person_and_zone(spark):
    d = spark.createDataFrame([("", "c", 1, " checkout "), (None, "c", None, "None"), ("7", "c", 1, "unknown")], "global_id string, camera_id string, track_id long, zone string")
    got = [tuple(r) for r in d.select(C.person_id(), C.clean_zone()).collect()]
    assert got == [("c_1", "checkout"), ("c_", None), ("7", None)]


def tracked(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, ts_us long, camera_id string, track_id long, global_id string, zone string")


def test_dwell_bounds_and_upper_median(spark):
    t0 = LOW * 1000
    rows = []
    for person, seconds in (("a", 10.1), ("b", 10.2), ("c", 60), ("d", 120), ("e", 600)):
        rows += [(t0, "c", 1, person, "x"), (t0 + int(seconds * 1e6), "c", 1, person, "x")]
    r = A.dwell_by_zone(tracked(spark, rows), "2024-01-15").first()
    assert (r.visits, r.median_minutes, r.avg_minutes) == (4, 2.0, 3.3)


def test_window_buckets_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    ts = sorted(LOW + int(x) for x in rng.integers(0, 4 * 3_600_000, 300))
    p = positions(spark, [(i, t, "a", i, 0.0, 0.0, "m", "a") for i, t in enumerate(ts)])
    best = max(((sum(t - 1_800_000 <= x <= t for x in ts)), -t) for t in ts)
    assert A.busiest_window(p, "2024-01-15").first()["rows"] == best[0]


def test_trail_rules(spark):
    s = 1_000_000
    rows = [(0, "c1", 1, "p", "a"), (s, "c2", 1, "p", "a"), (2 * s, "c2", 1, "p", ""), (3 * s, "c2", 1, "p", "b"), (4 * s, "c2", 1, "p", "c")]
    got = sorted((r.zone, r.cam, r.entry_us, r.exit_us) for r in W.zone_trail(tracked(spark, rows)).collect())
    assert got == [("b", "c2", 3 * s, 4 * s), ("c", "c2", 4 * s, None)]


def test_exit_gate(spark):
    s = 1_000_000
    c = spark.createDataFrame([("c", 1, 0, 0, "entry"), ("c", 1, int(7.9 * s), 1, "exit"), ("c", 1, 8 * s, 2, "exit")], "camera_id string, track_id long, ts_us long, event_id long, kind string")
    assert sorted(r.event_id for r in G.gate_crossings(c).collect()) == [0, 2]


def test_throttle_replay(spark):
    rng = np.random.default_rng(1)
    ts = np.sort(rng.integers(0, 1000, 200))
    kept, last = [], None
    for i, t in enumerate(ts):
        if last is None or t - last >= 7:
            kept.append(i)
            last = t
    assert G.keep_spaced(ts, 7).tolist() == kept


def test_polygon_edges(spark):
    z = spark.createDataFrame([("c", 0, "line", [(0, 0), (10, 10)]), ("c", 1, "first", [(0, 0), (10, 0), (10, 10), (0, 10)]), ("c", 2, "second", [(5, 5), (20, 5), (20, 20)])], "camera_id string, zone_idx int, zone string, vertices array<struct<x:int,y:int>>")
    d = spark.createDataFrame([("c", 10, 5), ("c", 0, 0), ("c", 15, 6), ("c", 30, 30), ("x", 1, 1)], "camera_id string, px int, py int")
    assert [r.zone for r in M.find_zone(d, z).orderBy("camera_id", "px").collect()] == ["first", "first", "second", "Unknown", "Unknown"]


def test_parallel_movement_does_not_cross(spark):
    d = spark.range(1).select(C.crosses_line(*map(F.lit, (0, 1, 10, 1, 0, 0, 10, 0))).alias("a"), C.crosses_line(*map(F.lit, (5, -1, 5, 1, 0, 0, 10, 0))).alias("b"), C.crosses_line(*map(F.lit, (5, -1, 5, 0, 0, 0, 10, 0))).alias("c"))
    assert tuple(d.first()) == (False, True, True)


def test_homography_is_recovered(spark):
    h = np.array([1.2, 0.1, 5, -0.2, 0.9, 3, 1e-4, 2e-4, 1.0])
    pts = [(0, 0), (100, 0), (100, 80), (0, 80)]
    rows = []
    for i, (x, y) in enumerate(pts):
        w = h[6] * x + h[7] * y + 1
        rows.append(("c", i, float(x), float(y), float((h[0] * x + h[1] * y + h[2]) / w), float((h[3] * x + h[4] * y + h[5]) / w)))
    d = spark.createDataFrame(rows, "camera_id string, idx int, cx double, cy double, wx double, wy double")
    assert np.allclose(list(M.fit_homography(d).first())[1:], h)


def test_quiet_hours_pass_midnight(spark):
    m = 60_000_000
    d = spark.createDataFrame([(x * m,) for x in (1319, 1320, 1439, 0, 389, 390)], "ts_us long")
    assert sorted(r.ts_us // m for r in E.quiet_hours(d, "22:00", "06:30").collect()) == [390, 1319]


def test_close_pairs_equal_brute_force(spark):
    s = X.snapshots(spark, SF)
    rows = s.collect()
    want = {(a.snap, a.person, b.person) for a in rows for b in rows if a.snap == b.snap and a.person < b.person and (a.world_x - b.world_x) ** 2 + (a.world_y - b.world_y) ** 2 < 900}
    assert {tuple(r) for r in J.close_pairs(s, 30).collect()} == want


def test_blocks_do_not_change_scores(spark):
    v = X.vectors(spark, SF)
    q = v.where("vec_id % 20 = 0").withColumn("query_id", F.col("vec_id"))
    whole = {(r.query_id, r.gid): round(r.score, 9) for r in V.identity_scores(q, v).collect()}
    cut = {(r.query_id, r.gid): round(r.score, 9) for r in V.identity_scores(q, v, block_rows=17, part_rows=3).collect()}
    assert whole == cut


def test_lockout(spark):
    s = 1_000_000
    rows = [(i, "ip", False, i * s) for i in range(5)] + [(9, "ip", False, 10 * s), (10, "ip", True, 910 * s)] + [(11 + i, "ip", False, (911 + i) * s) for i in range(4)]
    d = spark.createDataFrame(rows, "event_id long, ip string, ok boolean, ts_us long")
    assert [tuple(r) for r in G.lockouts(d).collect()] == [("ip", 4 * s, 904 * s)]


def test_questions(spark):
    cams = spark.createDataFrame([(0, "camera_1", ["Entrada"]), (1, "camera_2", ["Till", "caixa"])], "idx int, camera_id string, names array<string>")
    q = ["How many people came today?", "Onde está a pessoa 42?", "What is happening at camera 3", "Where has person 7 been", "queue at the caixa", None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(q)], "i int, q string")
    got = [(r.type, r.camera_id, r.person_id, r.needs_vlm) for r in questions.classify_questions(d, "q", cams).orderBy("i").collect()]
    assert got == [("historical", None, None, False), ("person", None, "42", False), ("scene", "camera_3", None, True), ("trail", None, "7", False), ("scene", "camera_2", None, True), ("store", None, None, True)]


def test_stream_equals_batch_crossings(spark):
    batch = G.gate_crossings(W.line_crossings(X.tracking(spark, SF, "fast_us"), seq.lines(spark)))
    assert sorted(map(tuple, streams.t4(spark, SF).collect())) == sorted(map(tuple, batch.collect()))


def test_csv_log_round_trip(spark, tmp_path):
    head = ",".join(f.name for f in logs.TRACKING)
    good = "c1,s1,camera_1,2024-01-15T10:00:00.5,7,,1,2,3,4,hall,male,adult,3,true,hall,entered"
    snap = "c1,s1,camera_1,2024-01-15T10:00:01,,,,,,,,,,3,false,,none"
    (tmp_path / "a.csv").write_text("\n".join([head, good, "broken", head, snap]) + "\n")
    df = logs.read_tracking_log(spark, str(tmp_path))
    assert df.count() == 2 and df.where("has_entered").count() == 1
    logs.write_landing(df, str(tmp_path / "landing"))
    assert spark.read.parquet(str(tmp_path / "landing")).where("year = 2024 and month = 1 and day = 15").count() == 2


def test_configuration_files(spark, tmp_path):
    z = '{"c": {"s": {"camera_1": {"type": "x", "zones": [{"sector_name": "b", "polygon_vertices": [[0,0],[4,0],[4,4]]}, {"sector_name": "a", "polygon_vertices": [[1,1],[2,2],[3,1]]}], "entrance_line": [[0,5],[9,5]]}, "camera_2": {"zones": []}}}}'
    (tmp_path / "z.json").write_text(z)
    assert [(r.zone_idx, r.zone, len(r.vertices)) for r in logs.read_zones(spark, str(tmp_path / "z.json")).orderBy("zone_idx").collect()] == [(0, "b", 3), (1, "a", 3)]
    assert [tuple(r)[2:] for r in logs.read_lines(spark, str(tmp_path / "z.json")).collect()] == [("camera_1", 0, 5, 9, 5, "left")]
    (tmp_path / "h.json").write_text('{"camera_1": {"H": [[1,0,0],[0,1,0],[0,0,1]]}}')
    assert logs.read_homographies(spark, str(tmp_path / "h.json")).first().h22 == 1.0
    (tmp_path / "k.json").write_text('{"camera_1": {"name": "A", "aliases": ["x"]}, "camera_2": {"name": "B", "enabled": false}}')
    assert sorted((r.camera_id, r.enabled, list(r.aliases)) for r in logs.read_cameras(spark, str(tmp_path / "k.json")).collect()) == [("camera_1", True, ["x"]), ("camera_2", False, [])]
