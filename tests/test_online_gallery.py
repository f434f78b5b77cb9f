"""The online gallery against a plain replay, over batches and a restart."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tracewell.plans import streams
from tracewell.streaming import gallery as G
from tracewell.streaming.jobs import new_folder

SF = "/root/testdata/sf0.001"
R = streams.GALLERY_RULES


def top3(q, e):
    return float(np.mean(sorted((float(q @ a) for a in [e["proto"], *e["anchors"]]), reverse=True)[:3]))


def veto(a, b):
    if a is None or b is None:
        return False
    if abs(a[0] - b[0]) > 0.60:
        return True
    for i, j in ((1, 3), (3, 5)):
        x, y = a[i:j], b[i:j]
        if max(x) >= 0.45 and max(y) >= 0.45 and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) < 0.35:
            return True
    return False


def replay(rows):
    """One store's rows in time order, as a device would go through them."""
    book, local, pending, told, fresh = {}, {}, {}, [], 1

    def enrich(e, v, q, attrs, colour, now):
        if max(float(a @ v) for a in e["anchors"]) < 0.72 and len(e["anchors"]) < 48:
            e["anchors"].append(v)
            e["q"].append(q)
        best = sorted(range(len(e["q"])), key=lambda i: -e["q"][i])[:8]
        m = np.mean([e["anchors"][i] for i in best], axis=0)
        e["proto"] = m / np.linalg.norm(m)
        if attrs is not None:
            e["attrs"] = attrs if e["attrs"] is None else 0.95 * e["attrs"] + 0.05 * attrs
        if colour is not None and q > 8:
            if e["colour"] is not None:
                colour = 0.8 * e["colour"] + 0.2 * colour
                colour = colour / np.linalg.norm(colour)
            e["colour"] = colour
        e["seen"] = now

    def match(v, attrs, colour, cam, now):
        found = []
        for gid, e in book.items():
            if veto(e["attrs"], attrs):
                continue
            s = top3(v, e)
            s = min(1.0, s + 0.12) if now - e["seen"] <= 90e6 else s
            c = 0.5 if colour is None or e["colour"] is None else min(1.0, max(0.0, float(colour @ e["colour"])))
            a = 0.5 if attrs is None or e["attrs"] is None else float(attrs @ e["attrs"] / np.linalg.norm(attrs) / np.linalg.norm(e["attrs"]))
            found.append((0.8 * s + 0.15 * c + 0.05 * a if e["cam"] == cam else 0.7 * s + 0.25 * c + 0.05 * a, -gid))
        found.sort(reverse=True)
        if not found:
            return None, 0.0
        gid = -found[0][1]
        need = 0.42 if book[gid]["cam"] == cam else 0.44
        if found[0][0] < need or len(found) > 1 and found[1][0] >= need and found[0][0] - found[1][0] < 0.03:
            return None, 0.0
        return gid, found[0][0]

    for r in sorted(rows, key=lambda r: (r["ts_us"], r["camera_id"], r["track_id"])):
        now, cam, key = r["ts_us"], r["camera_id"], (r["camera_id"], r["track_id"])
        v, attrs, colour = (None if r[c] is None else np.array(r[c]) for c in ("embedding", "attributes", "colour"))
        book = {g: e for g, e in book.items() if now - e["seen"] <= 7200e6}
        local = {k: x for k, x in local.items() if now - x[1] <= 60e6}
        pending = {k: b for k, b in pending.items() if now - b[-1][0] <= 60e6}
        if key in local:
            gid = local[key][0]
            local[key] = (gid, now)
            if gid in book and top3(v, book[gid]) >= 0.32:
                enrich(book[gid], v, r["sharpness"], attrs, colour, now)
            continue
        buf = pending.setdefault(key, [])
        buf.append((now, v, r["sharpness"], attrs))
        sharp = max(buf, key=lambda b: b[2])
        busy = lambda g: any(k[0] == cam and k != key and x[0] == g for k, x in local.items()) or book[g]["cam"] == cam and now - book[g]["seen"] < 15e6  # noqa: E731, B023
        got, score = None, 0.0
        for b in buf:
            m = match(b[1], b[3], colour, cam, now)
            if m[0] is not None and m[1] > score:
                got, score = m
        if len(buf) >= 3:
            m = sum(b[1] * max(b[2], 0.1) for b in buf)
            m = match(m / np.linalg.norm(m), sharp[3], colour, cam, now)
            if m[0] is not None and m[1] > score:
                got, score = m
        how = "match"
        if got is not None and busy(got):
            got = None
        if got is None:
            if len(buf) < R.window:
                continue
            how, near = "rescue", [(top3(sharp[1], e), -g) for g, e in book.items() if now - e["seen"] <= 90e6 and not veto(e["attrs"], attrs)]
            if near and max(near)[0] >= 0.36 and not busy(-max(near)[1]):
                got = -max(near)[1]
        if got is None:
            how = "closed"
            near = [(top3(sharp[1], e), -g) for g, e in book.items() if e["cam"] == cam and 5e6 < now - e["seen"] < 120e6 and not busy(g) and not veto(e["attrs"], attrs)]
            if near and max(near)[0] >= (0.15 if len(near) == 1 else 0.25):
                got = -max(near)[1]
        if got is None:
            how, got, fresh = "new", fresh, fresh + 1
            book[got] = {"cam": cam, "anchors": [sharp[1]], "q": [sharp[2]], "proto": sharp[1], "attrs": attrs, "colour": colour, "seen": now}
        else:
            enrich(book[got], sharp[1], sharp[2], attrs, colour, now)
        local[key] = (got, now)
        pending.pop(key)
        told.append((r["store"], cam, r["track_id"], now, got, how))
    return told


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict() for r in streams.visits(spark, SF).collect()]


@pytest.fixture(scope="module")
def want(rows):
    return sorted(x for s in {r["store"] for r in rows} for x in replay([r for r in rows if r["store"] == s]))


def test_every_match_changes_the_gallery(spark, want):
    got = sorted(tuple(r) for r in streams.v18_online(spark, SF).select("store", "camera_id", "track_id", "ts_us", "gid", "how").collect())
    assert got == want
    how = Counter(x[-1] for x in want)
    assert min(how[x] for x in ("match", "new", "closed")) > 3, how
    # three hours later all had expired
    assert any(x[-1] == "new" and x[2] % 3 == 2 for x in want)


def test_batches_and_a_restart_give_the_same_ids(spark, want):
    """Six files in time order, one a batch; the stream stops after three and goes on from its checkpoint."""
    G.use_rocks(spark)
    path = new_folder(spark, "visits")
    table = streams.visits(spark, SF).cache()
    times = sorted(r.ts_us for r in table.select("ts_us").collect())
    cuts = [times[len(times) * i // 6] for i in range(6)] + [times[-1] + 1]

    def run():
        stream = streams.timed(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
        out = G.online_assignment(stream, R, "1 second")
        q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    for i in range(6):
        table.where(F.col("ts_us").between(cuts[i], cuts[i + 1] - 1)).coalesce(1).write.mode("append").parquet(f"{path}/in")
        if i == 2:
            run()
    run()
    got = spark.read.parquet(f"{path}/out").select("store", "camera_id", "track_id", "ts_us", "gid", "how").collect()
    assert sorted(tuple(r) for r in got) == want
    table.unpersist()


def test_pools_are_kept_up():
    """Vectors of identities that come, grow, shrink and go, against each identity's own pool; work is one product a question."""
    rng = np.random.default_rng(8)
    held, pools = {}, G.Pools({})
    assert not len(pools.like(rng.normal(size=6))[0])
    for step in range(400):
        gid = int(rng.integers(1, 60))
        if gid in held and rng.random() < 0.3:
            del held[gid]
            pools.drop(gid)
        else:
            anchors = [rng.normal(size=6) for _ in range(int(rng.integers(1, 9)))]
            held[gid] = G.Entry("c", 0, 1, rng.normal(size=6), anchors, [1.0] * len(anchors), None, None)
            pools.put(gid, held[gid])
        if step % 20 == 0:
            v = rng.normal(size=6)
            gids, s = pools.like(v)
            assert dict(zip(gids.tolist(), s.tolist(), strict=True)) == pytest.approx({g: np.sort(e.pool() @ v)[-3:].mean() for g, e in held.items()})
    assert len(pools.rows) < 1100
