"""Queries without SQL against plain Python over the same rows."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tracewell.functions import geometry as M
from tracewell.operators import alerts as E
from tracewell.operators import gates as G
from tracewell.operators import identity as V
from tracewell.operators import joins as J
from tracewell.operators import traffic as A
from tracewell.plans import identity as P
from tracewell.plans import joins, streams
from tracewell.plans.registry import QUERIES
from tracewell.sources import adapters as X

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


def vectors(spark):
    return [{**r, "embedding": np.array(r["embedding"])} for r in rows(X.vectors(spark, SF))]


def unit(v):
    return v / np.linalg.norm(v)


# ---- folds over time ---------------------------------------------------------------


def test_smooth(spark):
    out = rows(QUERIES["w3_smooth_positions"](spark, SF))
    names = [c for c in out[0] if c.endswith("_smooth")]
    d = spark.createDataFrame([(i % 3, i * 7 % 50, i, (i * 37) % 101) for i in range(60)], "key long, ts long, id long, x long")
    got = {r["id"]: r["x_smooth"] for r in rows(G.smooth(d, ["key"], ["ts", "id"], ["x"]))}
    last, want = {}, {}
    for r in sorted(rows(d), key=lambda r: (r["key"], r["ts"], r["id"])):
        y = r["x"] if r["key"] not in last else 0.35 * r["x"] + 0.65 * last[r["key"]]
        last[r["key"]], want[r["id"]] = y, int(y)
    assert names and got == want


def test_scans_keep_what_a_whole_fold_keeps(spark):
    rng = np.random.default_rng(3)
    times = np.cumsum(rng.choice([1, 2, 9, 40], 300)).tolist()
    d = spark.createDataFrame([(i % 2, t, i) for i, t in enumerate(times)], "key long, ts long, id long")
    got = {r["id"] for r in rows(G.throttle(d, ["key"], "ts", 10, ["id"]))}
    want, last = set(), {}
    for i, t in enumerate(times):
        if i % 2 not in last or t - last[i % 2] >= 10:
            want.add(i)
            last[i % 2] = t
    assert got == want


def test_cooldown(spark):
    t = X.tracking(spark, SF, "fast_us")
    c = E.dwell_alerts(t, 1).union(E.dwell_alerts(t, 2, "loitering"))
    fired = {(r["type"], r["entity"], r["ts_us"]) for r in rows(G.apply_cooldown(c, {"dwell": 30.0, "loitering": 60.0}))}
    want, last = set(), {}
    for kind, entity, ts in sorted({(r["type"], r["entity"], r["ts_us"]) for r in rows(c)}):
        gap = {"dwell": 30e6, "loitering": 60e6}[kind]
        if (kind, entity) not in last or ts - last[kind, entity] >= gap:
            want.add((kind, entity, ts))
            last[kind, entity] = ts
    assert want and fired == want and QUERIES["al7_apply_cooldown"](spark, SF).columns


# ---- joins -------------------------------------------------------------------------


def test_stitch_tracks(spark):
    table = joins.segments(spark, SF).withColumn("has_entered", F.pmod(F.xxhash64("seg"), F.lit(5)) == 0)
    stitched = J.stitch_tracks(table, max_gap=600.0)
    seg = sorted(rows(joins.segments(spark, SF)), key=lambda s: (s["start_us"], s["seg"]))
    first, held, want = {}, {}, {}
    old = sorted(seg, key=lambda s: (s["start_us"], s["seg"]))
    for n in seg:
        for o in old:
            gap = n["start_us"] - o["end_us"]
            near = (n["sx"] - o["ex"]) ** 2 + (n["sy"] - o["ey"]) ** 2 < 500**2
            if n["camera_id"] == o["camera_id"] and n["seg"] != o["seg"] and 500_000 < gap < 600_000_000 and near:
                root = first.get(o["seg"], o["seg"])
                if held.get(root, -1) < n["start_us"]:
                    first[n["seg"]], held[root] = root, n["end_us"]
                    want[n["seg"]] = (o["seg"], root)
                    break
    got = {r["seg"]: (r["old_id"], r["root"]) for r in rows(stitched)}
    assert want and got == want
    entered, flag = {}, {r["seg"]: r["has_entered"] for r in rows(table)}
    for n in seg:
        root = first.get(n["seg"], n["seg"])
        entered[root] = entered.get(root, False) or flag[n["seg"]]
        flag[n["seg"]] = entered[root]
    assert {r["seg"]: r["has_entered"] for r in rows(J.inherited(table, stitched))} == flag


def test_groups(spark):
    linked = defaultdict(list)
    for r in rows(QUERIES["j6_lasting_pairs"](spark, SF)):
        linked[r["snap"]].append({r["a"], r["b"]})
    want = set()
    for snap, sets in linked.items():
        whole: list[set] = []
        for s in sets:
            apart = [w for w in whole if not w & s]
            whole = [*apart, set().union(s, *(w for w in whole if w & s))]
        want |= {(snap, min(w), len(w), tuple(sorted(w))) for w in whole}
    assert {(r["snap"], r["group"], r["size"], tuple(r["members"])) for r in rows(QUERIES["j6_groups"](spark, SF))} == want


# ---- traffic -----------------------------------------------------------------------


def test_density_blur(spark):
    rng = np.random.default_rng(1)
    w, h = 40, 36
    g = np.zeros((h, w))
    for y, x, n in zip(rng.integers(0, h, 30), rng.integers(0, w, 30), rng.integers(1, 9, 30), strict=True):
        g[y, x] = n
    cells = [("c", int(x), int(y), int(g[y, x])) for y, x in zip(*np.nonzero(g), strict=True)]
    got = {(r["bx"], r["by"]): (r["value"], r["alpha"]) for r in rows(M.smooth_density(spark.createDataFrame(cells, "camera_id string, bx int, by int, n long"), w, h))}
    k = M.gaussian_kernel()
    pad = len(k) // 2
    mirror = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    blurred = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            blurred[y, x] = sum(k[i + pad] * k[j + pad] * g[mirror(y + i, h), mirror(x + j, w)] for i in range(-pad, pad + 1) for j in range(-pad, pad + 1))
    value = np.floor(blurred / blurred.max() * 255 + 1e-9).astype(int)
    want = {(x, y): value[y, x] for y, x in zip(*np.nonzero(value), strict=True)}
    assert set(got) >= {p for p, v in want.items() if v > 1}
    assert all(abs(got[p][0] - want.get(p, 0)) <= 1 for p in got) and all(a == (0 if v < 3 else int(v * 0.85)) for v, a in got.values())


def test_dashboard_is_its_parts(spark):
    got = rows(QUERIES["a21_dashboard"](spark, SF))
    p = X.positions(spark, SF)
    text = str(got)
    assert got and str(A.daily_visitors(p, "2024-01-15").first()[0]) in text and str(A.peak_hour(p, "2024-01-15").first()[0]) in text


# ---- identities --------------------------------------------------------------------


def test_anchor_bank(spark):
    want = set()
    by = defaultdict(list)
    for r in sorted(vectors(spark), key=lambda r: r["ts"]):
        by[r["gid"]].append(r)
    for most, novelty in ((48, 0.72), (2, 0.9)):
        want = set()
        for own in by.values():
            bank: list = []
            for r in own:
                if bank and max(b["embedding"] @ r["embedding"] for b in bank) >= novelty:
                    continue
                if len(bank) < most:
                    bank.append(r)
                elif r["quality"] > min(b["quality"] for b in bank):
                    bank[min(range(len(bank)), key=lambda i: bank[i]["quality"])] = r
            want |= {(r["gid"], r["ts"]) for r in bank}
        got = {(r["gid"], r["ts"]) for r in rows(V.anchor_bank(X.vectors(spark, SF), most, novelty))}
        assert got == want


def test_colour_profile(spark):
    want = {}
    for r in sorted(vectors(spark), key=lambda r: r["ts"]):
        if r["quality"] / 5 > 8:
            c = np.abs(r["embedding"][:8])
            want[r["gid"]] = c if r["gid"] not in want else unit(0.8 * want[r["gid"]] + 0.2 * c)
    got = {r["gid"]: r["profile"] for r in rows(QUERIES["v10_colour_profile"](spark, SF))}
    assert set(got) == set(want) and all(np.allclose(got[g], want[g], atol=2e-6) for g in want)


def test_merges(spark):
    pairs = sorted((r["a"], r["b"]) for r in rows(QUERIES["v14_duplicate_pairs"](spark, SF)))
    g = {r["gid"]: r for r in rows(P.gallery(spark, SF))}
    veto = lambda x, y: max(x) >= 0.25 and max(y) >= 0.25 and unit(np.array(x)) @ unit(np.array(y)) < 0.6
    gone, proto = {}, {i: np.array(r["prototype"]) for i, r in g.items()}
    for a, b in pairs:
        keep, drop = (a, b) if g[a]["hits"] >= g[b]["hits"] else (b, a)
        if keep in gone or drop in gone or veto(g[a]["colour"], g[b]["colour"]):
            continue
        gone[drop] = keep
        proto[keep] = unit(proto[keep] + proto[drop])

    def root(x):
        while x in gone:
            x = gone[x]
        return x

    got = rows(QUERIES["v15_merge_identities"](spark, SF))
    assert gone and {r["gid"]: r["kept"] for r in got if r["gid"] != r["kept"]} == {x: root(x) for x in gone}
    assert all(np.allclose(r["prototype"], proto[r["gid"]], atol=2e-6) for r in got if r["gid"] == r["kept"])
    whole = defaultdict(list)
    for r in vectors(spark):
        whole[root(r["gid"])].append(r)
    want = {x: (sum(g[o]["hits"] for o in g if root(o) == x), min(6, len(v)), sum(sorted((r["quality"] for r in v), reverse=True)[:6]), len(v)) for x, v in whole.items()}
    assert {r["gid"]: (r["hits"], r["anchors"], r["quality"], r["tracks"]) for r in rows(QUERIES["v15_merged_gallery"](spark, SF))} == want


def replayed_assignment(spark):
    tracks, anchors, gallery, held, recent, as_of = P.assignment_inputs(spark, SF)
    pool = defaultdict(list)
    for r in rows(anchors):
        pool[r["gid"]].append(np.array(r["embedding"]))
    g = {r["gid"]: r for r in rows(gallery)}
    lately = {r["gid"] for r in rows(recent)}
    busy = [r for r in rows(held) if r["ts_us"] > as_of - 15_000_000]
    blocked = lambda gid, cam, t: any(b["gid"] == gid and b["camera_id"] == cam and b["track_id"] != t for b in busy)
    sim = lambda v, gid: np.mean(sorted((float(v @ a) for a in pool[gid]), reverse=True)[:3])

    arr = lambda x: None if x is None else np.array(x)
    worn = {x: (arr(g[x]["attributes"]), arr(g[x]["colour"])) for x in g}

    def veto(a, gid):
        b = worn[gid][0]
        if a is None or b is None:
            return False
        x, y = a[1:], b[1:]
        return abs(a[0] - b[0]) > 0.6 or max(x) >= 0.25 and max(y) >= 0.25 and x @ y / np.sqrt((x @ x) * (y @ y)) < 0.6

    def best(v, cam, attrs, colour):
        s = []
        for gid in sorted(g):
            if veto(attrs, gid):
                continue
            e = sim(v, gid)
            e = min(1.0, e + 0.12) if gid in lately else e
            same = g[gid]["camera_id"] == cam
            a, c = worn[gid]
            t = 0.5 if attrs is None or a is None else attrs @ a / np.sqrt((attrs @ attrs) * (a @ a))
            c = 0.5 if colour is None or c is None else min(1.0, max(0.0, colour @ c))
            s.append((0.8 * e + 0.15 * c + 0.05 * t if same else 0.7 * e + 0.25 * c + 0.05 * t, -gid))
        s.sort(reverse=True)
        if not s:
            return None, 0.0
        gid = -s[0][1]
        need = 0.42 if g[gid]["camera_id"] == cam else 0.44
        if s[0][0] < need or len(s) > 1 and s[1][0] >= need and s[0][0] - s[1][0] < 0.03:
            return None, 0.0
        return gid, s[0][0]

    by = defaultdict(list)
    for r in sorted(rows(tracks), key=lambda r: r["ts"]):
        by[r["camera_id"], r["track_id"]].append((np.array(r["embedding"]), r["sharpness"], arr(r["attributes"]), arr(r["colour"])))
    out, left = {}, []
    for (cam, t), buf in sorted(by.items()):
        got = None
        for n in range(1, min(7, len(buf)) + 1):
            top = (None, 0.0)
            colour = buf[n - 1][3]
            for v, _, attrs, _ in buf[:n]:
                m = best(v, cam, attrs, colour)
                top = m if m[0] is not None and m[1] > top[1] else top
            if n >= 3:
                m = best(unit(sum(b[0] * max(b[1], 0.1) for b in buf[:n])), cam, max(buf[:n], key=lambda x: x[1])[2], colour)
                top = m if m[0] is not None and m[1] > top[1] else top
            if top[0] is not None and not blocked(top[0], cam, t):
                got = (top[0], "match")
                break
        v, attrs = max(buf[:7], key=lambda x: x[1])[0], buf[:7][-1][2]
        if got is None:
            s = sorted(((sim(v, x), -x) for x in lately if not veto(attrs, x)), reverse=True)
            if s and s[0][0] >= 0.36 and not blocked(-s[0][1], cam, t):
                got = (-s[0][1], "rescue")
        if got is None:
            free = {b["gid"] for b in busy if b["camera_id"] == cam}
            c = [x for x in g if g[x]["camera_id"] == cam and not g[x]["assigned"] and 5 <= (as_of - g[x]["last_us"]) / 1e6 <= 120 and x not in free and not veto(attrs, x)]
            s = sorted(((sim(v, x), -x) for x in c), reverse=True)
            if s and s[0][0] >= (0.15 if len(c) == 1 else 0.25):
                got = (-s[0][1], "closed")
        if got is None:
            left.append((cam, t))
        else:
            out[cam, t] = got
    top = max(pool)
    return out | {x: (top + 1 + i, "new") for i, x in enumerate(sorted(left))}


def test_assignment(spark):
    got = {(r["camera_id"], r["track_id"]): (r["gid"], r["how"]) for r in rows(QUERIES["v18_assign_identities"](spark, SF))}
    assert got == replayed_assignment(spark)
    assert {"match", "new"} <= {how for _, how in got.values()}


def test_nms(spark):
    frames = defaultdict(list)
    for r in rows(P.detections(spark, SF)):
        frames[r["camera_id"], r["frame"]].append(r)
    want = set()
    for own in frames.values():
        kept: list = []
        for r in sorted(own, key=lambda r: (-r["score"], r["event_id"])):
            for k in kept:
                w = min(r["x2"], k["x2"]) - max(r["x1"], k["x1"])
                h = min(r["y2"], k["y2"]) - max(r["y1"], k["y1"])
                if w > 0 and h > 0 and w * h / (2 * 80 * 160 - w * h) > 0.45:
                    break
            else:
                kept.append(r)
        want |= {r["event_id"] for r in kept}
    got = {r["event_id"] for r in rows(QUERIES["v19_nms"](spark, SF))}
    assert got == want and len(got) < sum(map(len, frames.values()))


# ---- streams -----------------------------------------------------------------------


def test_stream_occupancy_is_exact_at_every_tick(spark):
    t = X.in_stores(X.tracking(spark, SF, "fast_us")).cache()
    newest = max(r["ts_us"] for r in rows(t)) // 1000 * 1000 - 600_000_000
    got = defaultdict(list)
    for r in rows(QUERIES["t2_stream_occupancy"](spark, SF)):
        got[r["store"], r["camera_id"]].append((r["at_us"], r["persons"]))
    for now in range(X.START_US + 7_000_000, newest, 397_000_000):
        want = {(r["store_id"], r["camera_id"]): r["persons"] for r in rows(A.live_occupancy(t, now, 8, by=["store_id"]))}
        assert want == {k: n for k, v in got.items() if (n := max((x for x in v if x[0] <= now), default=(0, 0))[1])}
    t.unpersist()


def test_stream_alerts_equal_batch_alerts(spark):
    """All rules and the cooldown in one plan, against the batch rules and the batch cooldown."""
    t, by = X.in_stores(X.tracking(spark, SF, "fast_us")), ["store_id"]
    log = X.in_stores(X.occupancy_log(spark, SF, "fast_us"))
    every = [E.queue_alerts(t, by=by), E.capacity_alerts(t, 20, by), E.dwell_alerts(t, by=by), E.loitering_alerts(t, by=by), E.surge_alerts(log, least=8, by=by)]
    both = every[0]
    for x in every[1:]:
        both = both.unionByName(x)
    newest = max(r["ts_us"] for r in rows(t)) // 1000 * 1000 - 600_000_000
    want = {(r["store_id"], r["type"], r["entity"], r["ts_us"], r["camera_id"]) for r in rows(G.apply_cooldown(both.drop("value"), E.COOLDOWNS, by)) if r["ts_us"] <= newest}
    got = {(r["store"], r["type"], r["entity"], r["ts_us"], r["camera_id"]) for r in rows(QUERIES["t6_stream_alerts"](spark, SF))}
    assert got == want
    assert {"dwell", "loitering", "surge"} <= {x[1] for x in got} and len({x[0] for x in got}) == 2


def test_stream_camera_offline(spark):
    last, newest = {}, 0
    for r in rows(X.tracking(spark, SF, "fast_us")):
        newest = max(newest, r["ts_us"])
        if r["camera_id"] != "camera_4" or r["ts_us"] < X.START_US + 600_000_000:
            last[r["camera_id"]] = max(last.get(r["camera_id"], 0), r["ts_us"])
    got = {(r["camera_id"], r["last_us"], r["at_us"]) for r in rows(QUERIES["t7_stream_camera_offline"](spark, SF))}
    silent = {c: t for c, t in last.items() if newest - t > 60_000_000}
    assert {c for c, *_ in got} == set(silent) == {"camera_4"}
    assert all(t == silent[c] and at == t + 45_000_000 for c, t, at in got)
    assert streams.tracking(spark, SF).isStreaming
