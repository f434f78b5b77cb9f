"""Selections, indexes and tables against brute force, and after a crash."""

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tracewell.functions import geometry as M
from tracewell.operators import identity as V
from tracewell.operators import joins as J
from tracewell.operators import traffic as A
from tracewell.operators import vector_index as N
from tracewell.plans import alerts as al
from tracewell.plans import identity as P
from tracewell.plans.registry import QUERIES
from tracewell.sources.shared import new_folder
from tracewell.streaming import upsert as U

SF = "/root/testdata/sf0.001"


def test_upper_median_by_digits(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.randrange(10), rng.randrange(1 << 20), rng.randrange(5_400_000_000)])) for k in "abcd" for _ in range(rng.choice([1, 2, 51, 300]))]
    rows += [(None, 7), (None, 9), ("e", 1 << 31), ("e", 1 << 31)]
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    df = spark.createDataFrame(rows, "k string, v long")
    assert {r.k: r.median for r in A.upper_median(df, ["k"], "v").collect()} == {k: sorted(v)[len(v) // 2] for k, v in by.items()}
    assert A.upper_median(df.limit(0), ["k"], "v").count() == 0


def test_nearest_frame_makes_one_row_an_event(spark):
    rng = random.Random(2)
    frames = [(f"c{i % 2}", rng.randrange(9000), f"p{i}") for i in range(300)]
    frames += [("c0", 50, "b"), ("c0", 50, "a"), ("c0", 60, "z")]
    events = [(i, f"c{i % 3}", rng.randrange(9500)) for i in range(200)] + [(900, "c0", 55), (901, "c0", 50)]
    want = {}
    for i, c, t in events:
        near = [(abs(ts - t), ts, p) for fc, ts, p in frames if fc == c and abs(ts - t) <= 300]
        if near:
            want[i] = min(near)[1:]
    got = J.nearest_frame(spark.createDataFrame(events, "id long, camera_id string, ts long"), spark.createDataFrame(frames, "camera_id string, ts long, path string"))
    assert {r.id: (r.frame_ts, r.path) for r in got.collect()} == want and want[900] == (50, "a")


def test_homography_leaves_outliers_out(spark):
    h = np.array([0.9, 0.1, 20.0, -0.05, 1.1, 10.0, 0.0002, 0.0001, 1.0])
    rng = np.random.default_rng(4)
    camera = rng.uniform(0, 1000, size=(60, 2))
    p = np.column_stack([camera, np.ones(60)]) @ h.reshape(3, 3).T
    world = p[:, :2] / p[:, 2:]
    bad = rng.choice(60, 18, replace=False)
    noisy = world.copy()
    noisy[bad] += rng.uniform(100, 800, size=(18, 2)) * rng.choice([-1, 1], size=(18, 2))
    assert np.allclose(M.consensus_homography(camera, world), M.solve_homography(camera, world))
    assert np.allclose(M.consensus_homography(camera, noisy), h, atol=1e-6)
    assert not np.allclose(M.solve_homography(camera, noisy), h, atol=1e-2)
    same = np.tile([[5.0, 5.0]], (6, 1))  # nothing to solve
    assert len(M.consensus_homography(same, world[:6])) == 9
    points = [("c", i, *map(float, camera[i]), *map(float, noisy[i])) for i in range(60)] + [("d", i, 0.0, 0.0, 0.0, 0.0) for i in range(3)]
    (r,) = M.fit_homography(spark.createDataFrame(points, "camera_id string, idx int, cx double, cy double, wx double, wy double")).collect()
    assert r.camera_id == "c" and np.allclose([r[f"h{i}{k}"] for i in range(3) for k in range(3)], h, atol=1e-6)


def test_cells_find_the_zones_of_a_full_test(spark):
    """A thousand zones a camera: the same zones, a few tests a row."""
    rng = random.Random(5)
    zones = []
    for i in range(1000):
        x, y, w, h = rng.randrange(1850), rng.randrange(1000), rng.randrange(5, 70), rng.randrange(5, 80)
        shape = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)] if i % 3 else [(x, y), (x + w, y + h // 2), (x, y + h)]
        zones.append(("c1", i, f"z{i}", shape))
    zones += [("c2", 0, "hall", [(0, 0), (1920, 0), (1920, 1080), (0, 1080)]), ("c2", 1, "never", [(0, 0), (100, 0), (100, 100)]), ("c2", 2, "line", [(0, 0), (9, 9)])]
    z = spark.createDataFrame(zones, "camera_id string, zone_idx int, zone string, vertices array<struct<x:int,y:int>>")
    # corners and edges of zones, too
    points = [(i, rng.choice(["c1", "c2", "c3"]), rng.randrange(-50, 2000), rng.randrange(-50, 1130)) for i in range(3000)] + [(5000 + i, "c1", *zones[i][3][0]) for i in range(1000)]
    df = spark.createDataFrame(points, "id long, camera_id string, px int, py int").cache()
    want = {r.id: r.zone for r in M.find_zone(df, z).collect()}
    got = M.find_zone_by_cell(df, M.zone_cells(z)).collect()
    assert {r.id: r.zone for r in got} == want and len(set(want.values())) > 100
    tests = [r.zone_tests for r in got if r.camera_id == "c1"]
    assert sum(tests) / len(tests) < 12 and max(tests) < 60
    assert sum(r.zone_tests for r in got if r.camera_id == "c2") < 0.2 * len([r for r in got if r.camera_id == "c2"])
    df.unpersist()


def clustered(n: int, seed: int) -> np.ndarray:
    """Vectors around well separated centres, as embeddings of persons are."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, 32))
    x = np.repeat(centres, 8, axis=0) + 0.25 * rng.normal(size=(n // 8 * 8, 32))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("part_rows", [20_000, 5])
def test_index_equals_a_full_search_and_skips_lists(spark, part_rows):
    x = clustered(800, 6)
    items = spark.createDataFrame([(i, i // 8, v.tolist()) for i, v in enumerate(x)], "vec_id long, gid long, embedding array<double>")
    queries = items.where("vec_id % 10 = 0").withColumn("query_id", F.col("vec_id"))
    rows = items.withColumn("gid", F.col("vec_id"))
    index = N.build(rows, own="vec_id", part_rows=part_rows)
    got, searched = N.topk(queries, index, 5, own="vec_id")
    pairs = lambda df: {(r.query_id, r["rank"]): (r.gid, round(r.score, 9)) for r in df.collect()}
    assert pairs(got) == pairs(V.cosine_topk(queries, rows, 5, own="vec_id"))
    lists = index.lists.centroids.shape[0]
    n = searched.select("list", "qid").distinct().count()
    assert n < 0.35 * lists * 80
    most = searched.groupBy("qid").agg(F.countDistinct("list").alias("n")).agg(F.max("n")).first()[0]
    assert most < lists
    scores = lambda df: {(r.query_id, r.gid): round(r.score, 9) for r in df.collect()}
    by_gid = N.build(items, own="vec_id", part_rows=part_rows)
    assert scores(N.identity_scores(queries, items, by_gid, 0.4, own="vec_id")) == scores(V.identity_scores(queries, items, least=0.4, own="vec_id"))


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, gid long, embedding array<double>")
    some = spark.createDataFrame([(1, 1, [1.0, 0.0])], "vec_id long, gid long, embedding array<double>").withColumn("query_id", F.col("vec_id"))
    assert N.topk(some, N.build(none), 3)[0].count() == 0
    assert N.topk(some.limit(0), N.build(some), 3)[0].count() == 0
    assert [tuple(r) for r in N.topk(some, N.build(some), 3)[0].collect()] == [(1, 1, 1.0, 1)]


def test_a_batch_done_again_after_a_crash_changes_nothing(spark, monkeypatch):
    schema = spark.createDataFrame([], "id string, ts long, camera_id string, reviewed int").schema
    path = new_folder(spark, "events")
    changes = al.changes(spark, SF)
    most = changes.agg(F.max("seq")).first()[0] + 1
    for part in range(4):
        changes.where(F.expr(f"least(3, seq * 4 div {most}) = {part}")).coalesce(1).write.mode("append").parquet(f"{path}/changes")
    whole = U.apply_batch
    told = []

    def dies(df, batch, *rest):
        whole(df, batch, *rest)
        told.append(batch)
        if told == [0, 1, 2]:
            raise RuntimeError("killed between write and commit")

    monkeypatch.setattr(U, "apply_batch", dies)

    def run():
        stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/changes")
        U.upsert_stream(stream, f"{path}/table", f"{path}/state", schema, 4).awaitTermination()

    with pytest.raises(Exception, match="killed between write and commit"):
        run()
    run()
    assert told == [0, 1, 2, 2, 3]
    got = sorted(tuple(r) for r in U.read_events(spark, f"{path}/table", schema).collect())
    want = sorted((r.id, r.ts, r.camera_id, r.reviewed) for r in QUERIES["e2_event_state"](spark, SF).collect())
    assert got == want


def test_deleted_events_stay_away(spark):
    """A bucket whose events are all gone keeps its newest, empty state."""
    schema = spark.createDataFrame([], "id string, ts long, camera_id string, reviewed int").schema
    path = new_folder(spark, "events")
    make = lambda rows: spark.createDataFrame(rows, "op string, seq long, id string, ts long, camera_id string, reviewed int")
    assert U.read_events(spark, f"{path}/none", schema).count() == 0
    U.apply_batch(make([("flag", 1, "a", 5, "c", 0), ("flag", 2, "b", 6, "c", 0)]), 0, path, schema, 1)
    U.apply_batch(make([("review", 3, "a", None, None, None)]), 1, path, schema, 1)
    assert sorted(tuple(r) for r in U.read_events(spark, path, schema).collect()) == [("a", 5, "c", 1), ("b", 6, "c", 0)]
    U.apply_batch(make([("delete", 4, "a", None, None, None), ("delete", 5, "b", None, None, None)]), 2, path, schema, 1)
    U.apply_batch(make([]), 3, path, schema, 1)
    assert U.read_events(spark, path, schema).count() == 0


def test_tiles_keep_groups_together(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE", 40)
    q, a = P.parts(spark, SF)
    small = V.identity_scores(q.withColumn("g", F.col("query_id") % 7), a, group="g", own="vec_id")
    got = {(r.query_id, r.gid): round(r.score, 9) for r in small.collect()}
    monkeypatch.undo()
    whole = V.identity_scores(q.withColumn("g", F.col("query_id") % 7), a, group="g", own="vec_id")
    assert got == {(r.query_id, r.gid): round(r.score, 9) for r in whole.collect()}


def test_tables_between_jobs_are_deleted(spark, tmp_path):
    import glob

    from tracewell.sources import shared

    left = lambda: len(glob.glob(shared.shared_folder(spark).removeprefix("file://") + "/*"))
    before = left()
    with shared.scratch(spark) as s:
        one = s.keep(shared.written(spark.range(5), "one"))
        shared.written(one.where("id > 1"), "two").write.parquet(f"{tmp_path}/out")
        assert left() == before + 2
    assert left() == before + 1 and one.count() == 5
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_lasting_pairs_shuffle_no_pairs(spark):
    """Where pairs meet in ever more ways the shuffle still carries persons only: no window over pairs, and groups link clumps."""
    import itertools
    import random

    rng = random.Random(3)
    rows = [(s, p, rng.uniform(0, 60), rng.uniform(0, 60)) for s in range(6) for p in range(40) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "snap long, person long, world_x double, world_y double")
    at = {(s, p): (x, y) for s, p, x, y in rows}
    near = lambda s, a, b: (s, a) in at and (s, b) in at and math.dist(at[s, a], at[s, b]) < 25
    for min_seconds, back in ((4, 1), (5, 2), (0, 1), (10, 3)):
        lasting = {(s, a, b) for s in range(6) for a, b in itertools.combinations(range(40), 2) if all(near(s - i, a, b) for i in range(back + 1))}
        got = [tuple(r) for r in J.lasting_pairs(df, 25, min_seconds=min_seconds).collect()]
        assert len(got) == len(set(got)) and set(got) == lasting
        groups = set()
        for s in range(6):
            left = {frozenset(p for t, a, b in lasting if t == s for p in (a, b) if x in (a, b)) for t, *ab in lasting if t == s for x in ab}
            while any(a & b for a, b in itertools.combinations(left, 2)):
                a, b = next((a, b) for a, b in itertools.combinations(left, 2) if a & b)
                left = (left - {a, b}) | {a | b}
            groups |= {(s, min(g), len(g), tuple(sorted(g))) for g in left}
        assert {(r.snap, r.group, r.size, tuple(r.members)) for r in J.groups(df, 25, min_seconds=min_seconds).collect()} == groups
    plan = J.lasting_pairs(df, 25)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")  # nothing above the join sorts pairs


def test_never_seen_joins_a_row_per_camera(spark):
    pings = spark.range(50_000).selectExpr("concat('c', id % 3) AS camera_id", "id AS ts_us")
    cameras = spark.createDataFrame([("c1", True), ("c7", True), ("c8", None), ("c9", False)], "camera_id string, enabled boolean")
    gone = J.never_seen(cameras, pings)
    assert sorted(r.camera_id for r in gone.collect()) == ["c7", "c8"]
    plan = gone._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]


def test_scores_leave_a_task_in_tiles(spark, monkeypatch):
    """A group of block and part returns bounded batches, and is the same in any order of batches and with rows that repeat."""
    monkeypatch.setattr(V, "TILE", 400)
    rng = np.random.default_rng(2)
    e = rng.normal(size=(60, 4))
    items = pd.DataFrame({"query": False, "id": np.arange(60) % 7, "g": np.arange(60) % 7, "o": np.arange(60), "e": list(e)})
    asked = pd.DataFrame({"query": True, "id": np.arange(30), "g": np.arange(30), "o": np.arange(30), "e": list(e[:30])})
    q, a = V.sides(iter([asked.iloc[:9], pd.concat([items, asked.iloc[9:]])]))
    places = V.Places(a.g)
    got = {}
    for part, s in V._tiles(q, a.take(places.order), False, "o"):
        assert s.size <= 400
        got |= {(i, g): x for i, row in zip(part.id, places.best_mean(s, 3), strict=True) for g, x in zip(places.ids, row, strict=True)}
    for i in range(30):
        for g in range(7):
            best = sorted((float(e[i] @ e[j]) for j in range(60) if j % 7 == g and j != i), reverse=True)[:3]
            assert got[i, g] == pytest.approx(sum(best) / 3)
    assert V._best_mean(iter([np.array([[-np.inf, 1.0]]), np.array([[-np.inf, -np.inf]])]), 3).tolist() == [[-np.inf, 1.0]]


def test_index_tasks_meet_shelves(spark, monkeypatch):
    """Queries go to shelves of lists and not to each list; an identity of several anchors stays in one list."""
    x = clustered(400, 9)
    items = spark.createDataFrame([(i, i // 8, v.tolist()) for i, v in enumerate(x)], "vec_id long, gid long, embedding array<double>")
    monkeypatch.setattr(N, "SHELF_ROWS", 150)
    index = N.build(items, own="vec_id")
    assert 2 <= index.shelves <= 4
    assert index.items.groupBy("iid").agg(F.countDistinct("list", "part", "shelf").alias("n")).agg(F.max("n")).first()[0] == 1
    queries = items.where("vec_id % 10 = 0").withColumn("query_id", F.col("vec_id"))
    scores = lambda df: {(r.query_id, r.gid): round(r.score, 9) for r in df.collect()}
    assert scores(N.identity_scores(queries, items, index, 0.3, own="vec_id")) == scores(V.identity_scores(queries, items, least=0.3, own="vec_id"))
