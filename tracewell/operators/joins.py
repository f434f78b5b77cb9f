"""As-of, range and proximity joins, always on bucket keys."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import person_id
from tracewell.operators.gates import sorted_scan
from tracewell.sources.shared import join_dimension, written


def near_in_time(left: DataFrame, right: DataFrame, key: str, lts: str, rts: str, back: int, ahead: int) -> DataFrame:
    """Pairs of one key with right time in [left - back, left + ahead].

    Times are cut into buckets as long as the span; a left row looks into the
    few buckets that it can reach, so the join is an equi-join.  Right columns
    keep their names, but for the key.
    """
    size = max(1, back + ahead)
    lo, hi = F.col(lts) - back, F.col(lts) + ahead
    reach = F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))
    a = left.withColumn("_b", F.explode(reach))
    b = right.withColumn("_rb", F.floor(F.col(rts) / size).cast("long")).withColumnRenamed(key, "_rk")
    return a.join(b, (F.col(key) == F.col("_rk")) & (F.col("_b") == F.col("_rb"))).where(F.col(rts).between(lo, hi)).drop("_b", "_rb", "_rk")


def nearest_frame(events: DataFrame, frames: DataFrame, window: int = 300, by: Sequence[str] = (), span: int = 8) -> DataFrame:
    """events (id, camera_id, ts seconds) with the closest frame inside the window; ties: the earlier.

    An as-of merge: both sides are laid into time buckets of `span` windows,
    frames near a border in the next bucket too, and sorted once each way; the
    last frame seen before and after a row is carried along.  One row an event
    comes out, no pairs are made, and a busy camera is as many groups as buckets.
    """
    size = span * window
    bucket = lambda c: F.floor(c / size).cast("long")
    t = F.col("ts")
    reach = F.array_distinct(F.array(bucket(t - window), bucket(t), bucket(t + window)))
    none = F.lit(None)
    kind = {f.name: f.dataType for f in events.schema}
    at = F.struct(F.col("ts").alias("frame_ts"), "path")
    f = frames.select(*by, "camera_id", "ts", F.explode(reach).alias("_b"), none.cast(kind["id"]).alias("id"), at.alias("_f"))
    e = events.select(*by, "camera_id", F.col("ts").cast(frames.schema["ts"].dataType).alias("ts"), bucket(t).alias("_b"), "id", none.cast(f.schema["_f"].dataType).alias("_f"))
    rows = e.withColumn("_event", F.lit(1)).unionByName(f.withColumn("_event", F.lit(0)))
    # at one moment frames come first both ways; of several with one time that of the smallest path is the last seen
    group = [*by, "camera_id", "_b"]
    before = Window.partitionBy(*group).orderBy("ts", "_event", F.col("_f.path").desc()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*group).orderBy(F.desc("ts"), "_event", F.col("_f.path").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_p", F.last("_f", True).over(before)).withColumn("_n", F.last("_f", True).over(after)).where("_event = 1")
    near = lambda c: F.when(F.abs(F.col(f"{c}.frame_ts") - t) <= window, F.struct(F.abs(F.col(f"{c}.frame_ts") - t).alias("d"), F.col(f"{c}.frame_ts").alias("frame_ts"), F.col(f"{c}.path").alias("path")))
    best = rows.withColumn("b", F.least(near("_p"), near("_n"))).where("b is not null")
    return best.select("id", *by, "camera_id", F.col("ts").cast(kind["ts"]).alias("ts"), "b.frame_ts", "b.path")


def clip_frames(events: DataFrame, frames: DataFrame, seconds: int, n: int | None = None) -> DataFrame:
    """Frames of the seconds before each event, evenly sampled to n."""
    f = frames.select("camera_id", F.col("ts").alias("frame_ts"), "path")
    clip = near_in_time(events, f, "camera_id", "ts", "frame_ts", seconds, 0).select("id", "camera_id", "ts", "frame_ts", "path")
    if n is None:
        return clip
    from tracewell.operators.sequences import even_sample

    return even_sample(clip, ["id"], ["frame_ts"], n)


def stitch_candidates(segments: DataFrame, min_gap: float = 0.5, max_gap: float = 45.0, max_dist: float = 500.0) -> DataFrame:
    """Pairs (new_id, old_id): the old segment ended on the camera 0.5..45 s before, near enough.

    segments: seg, camera_id, start_us, end_us, sx, sy, ex, ey.
    """
    old = segments.select(F.col("seg").alias("old_id"), "camera_id", F.col("start_us").alias("old_start"), "end_us", "ex", "ey")
    new = segments.select(F.col("seg").alias("new_id"), "camera_id", "start_us", "sx", "sy")
    pairs = near_in_time(new, old, "camera_id", "start_us", "end_us", int(max_gap * 1e6), 0)
    gap = F.col("start_us") - F.col("end_us")
    dist = F.sqrt((F.col("sx") - F.col("ex")) ** 2 + (F.col("sy") - F.col("ey")) ** 2)
    ok = (gap > min_gap * 1e6) & (gap < max_gap * 1e6) & (dist < max_dist) & (F.col("new_id") != F.col("old_id"))
    return pairs.where(ok).select("camera_id", "start_us", "new_id", "old_id", "old_start")


def stitch_tracks(segments: DataFrame, min_gap: float = 0.5, max_gap: float = 45.0, max_dist: float = 500.0, by: Sequence[str] = ()) -> DataFrame:
    """(seg, old_id, root): each new segment's predecessor, if any, and the first segment of its chain, whose id it takes.

    A sweep over each camera's segments in order of start.  The state holds what
    can still matter: segments that run or ended less than `max_gap` before, and
    the ids that run.  Each new segment takes the first candidate (it ended
    min_gap..max_gap before and close by), in the order in which the old ones
    appeared, whose id no track holds at that instant.  State and work are
    bounded by the tracks alive at once, however long they chain.

    segments: seg, camera_id, start_us, end_us, sx, sy, ex, ey.
    """
    kind = segments.schema["seg"].dataType.simpleString()
    names = [*by, "camera_id", "start_us", "seg", "end_us", "sx", "sy", "ex", "ey"]

    def step(state, pdf: pd.DataFrame):
        old, held = state or ([], {})  # (start, seg, end, x, y, root) in order of appearance; root -> end of its last segment
        out = []
        for r in pdf[names[len(by) :]].itertuples(index=False):
            old = [o for o in old if r.start_us - o[2] < max_gap * 1e6]
            live = {o[5] for o in old}
            held = {root: end for root, end in held.items() if end >= r.start_us or root in live}
            root = r.seg
            for _, seg, end, x, y, first in old:
                gap = r.start_us - end
                if gap > min_gap * 1e6 and (r.sx - x) ** 2 + (r.sy - y) ** 2 < max_dist**2 and held.get(first, -1) < r.start_us:
                    out.append((seg, r.seg, first))
                    root = first
                    break
            held[root] = max(held.get(root, r.end_us), r.end_us)
            old.append((r.start_us, r.seg, r.end_us, r.ex, r.ey, root))
        made = pd.DataFrame(out, columns=["old_id", "seg", "root"])[["seg", "old_id", "root"]]
        for i, k in enumerate(by):
            made.insert(i, k, pdf[k].iloc[0])
        return (old, held), made

    head = "".join(f"{k} {segments.schema[k].dataType.simpleString()}, " for k in by)
    return sorted_scan(segments.select(*names), [*by, "camera_id"], ["start_us", "seg"], step, f"{head}seg {kind}, old_id {kind}, root {kind}")


def inherited(segments: DataFrame, stitched: DataFrame, flag: str = "has_entered") -> DataFrame:
    """Segments with `track` (the first of their chain) and `flag`, true once an earlier or the own segment of the chain has it."""
    s = stitched.select(F.col("seg").alias("_s"), "root")
    rows = segments.join(s, F.col("seg") == F.col("_s"), "left").withColumn("track", F.coalesce("root", "seg")).drop("_s", "root")
    so_far = Window.partitionBy("track").orderBy("start_us", "seg").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(flag, F.coalesce(F.max(flag).over(so_far), F.lit(False)))


def camera_offline(cameras: DataFrame, pings: DataFrame, as_of: int, seconds: int = 45) -> DataFrame:
    """Enabled cameras whose last ping (ts_us) is older; those never pinged are left out."""
    last = pings.groupBy("camera_id").agg(F.max("ts_us").alias("last_us"))
    on = cameras.where(F.coalesce("enabled", F.lit(True))).select("camera_id")
    return on.join(last, "camera_id").where(F.lit(as_of) - F.col("last_us") > seconds * 1_000_000)


def never_seen(cameras: DataFrame, pings: DataFrame) -> DataFrame:
    """Enabled cameras without a ping; pings become a row per camera before they are joined."""
    seen = pings.select("camera_id").distinct()
    return cameras.where(F.coalesce("enabled", F.lit(True))).select("camera_id").join(seen, "camera_id", "left_anti")


def _near(points: DataFrame, keys: Sequence[str], dist: float, at: int = 0) -> DataFrame:
    """Pairs (keys, l, r) of points closer than `dist` at each of their places; each pair once, its sides in any order.

    points: keys, `p` (whatever names the point) and the places x0, y0, x1, y1, ... up to number `at`.  A cell is as
    wide as the distance: a point meets those of its own cell and of four of the cells around (the others meet it),
    by an equi-join on the cells of the first place.
    """
    cell = lambda x: F.floor(F.col(x) / dist).cast("long")
    places = [f"{c}{i}" for i in range(at + 1) for c in "xy"]
    l = points.select(*keys, F.col("p").alias("l"), *[F.col(c).alias(f"l{c}") for c in places], cell("x0").alias("gx"), cell("y0").alias("gy"))
    ahead = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    r = points.select(*keys, F.col("p").alias("r"), *[F.col(c).alias(f"r{c}") for c in places], cell("x0").alias("cx"), cell("y0").alias("cy"), F.explode(ahead).alias("o"))
    own = (F.col("o.i") == 0) & (F.col("o.j") == 0)
    r = r.select(*keys, "r", *[f"r{c}" for c in places], (F.col("cx") + F.col("o.i")).alias("gx"), (F.col("cy") + F.col("o.j")).alias("gy"), own.alias("own"))
    pairs = l.join(r, [*keys, "gx", "gy"]).where("if(own, l < r, l <> r)")
    for i in range(at + 1):
        pairs = pairs.where((F.col(f"lx{i}") - F.col(f"rx{i}")) ** 2 + (F.col(f"ly{i}") - F.col(f"ry{i}")) ** 2 < dist * dist)
    return pairs.select(*keys, "l", "r")


def close_pairs(snapshots: DataFrame, dist: float = 100.0, by: Sequence[str] = ()) -> DataFrame:
    """Pairs (snap, a, b), a < b, of persons closer than `dist` in one snapshot; a person has one row a snapshot."""
    keys = [*by, "snap"]
    points = snapshots.select(*keys, F.col("person").alias("p"), F.col("world_x").alias("x0"), F.col("world_y").alias("y0"))
    return _near(points, keys, dist).select(*keys, F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))


def _steps(step_s: float, min_seconds: float) -> int:
    """How many snapshots before a pair must have been close for longer than min_seconds."""
    m = max(0, int(min_seconds // step_s))
    return m if m * step_s > min_seconds else m + 1


def _chains(snapshots: DataFrame, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """(snap, p, x0, y0, ..., x<steps>, y<steps>): persons seen in each of the last steps + 1 snapshots, with their places, newest first."""
    w = Window.partitionBy(*by, "person").orderBy("snap")
    rows = snapshots.where("snap is not null and person is not null")
    at = F.struct("snap", "world_x", "world_y")
    rows = rows.select(*by, "snap", F.col("person").alias("p"), at.alias("_0"), *[F.lag(at, i).over(w).alias(f"_{i}") for i in range(1, steps + 1)])
    rows = rows.where(F.col(f"_{steps}.snap") == F.col("snap") - steps)
    return rows.select(*by, "snap", "p", *[F.col(f"_{i}.world_{c}").alias(f"{c}{i}") for i in range(steps + 1) for c in "xy"])


def lasting_pairs(snapshots: DataFrame, dist: float = 100.0, step_s: float = 5.0, min_seconds: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Pairs (snap, a, b), a < b, that have been close in every snapshot for longer than min_seconds.

    Only persons seen in that many snapshots on end meet, with all their places; no pair is
    shuffled or sorted.  A person has one row a snapshot.
    """
    keys, steps = [*by, "snap"], _steps(step_s, min_seconds)
    return _near(_chains(snapshots, steps, by), keys, dist, steps).select(*keys, F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))


def groups(snapshots: DataFrame, dist: float = 100.0, step_s: float = 5.0, min_seconds: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Groups (snap, group, size, members) of persons linked by lasting pairs.

    Persons who were in the same small square (narrower than dist / sqrt 2) each time are all linked, so they form a clump
    named by its smallest person.  Links between clumps are made distinct in the task that finds them: what is shuffled,
    and folded for each snapshot, are clumps and not pairs.
    """
    keys, steps = [*by, "snap"], _steps(step_s, min_seconds)
    places = [f"{c}{i}" for i in range(steps + 1) for c in "xy"]
    seen = _chains(snapshots, steps, by).dropna(subset=places)
    square = F.array(*[F.floor(F.col(c) * 1.5 / dist).cast("long") for c in places])
    seen = written(seen.withColumn("clump", F.min("p").over(Window.partitionBy(*keys, square))), "clumps")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(pdf["l"], pdf["r"], strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        own = [pdf[k].iloc[0] for k in keys]
        return pd.DataFrame([(*own, x, root(x)) for x in list(parent)], columns=[*keys, "clump", "group"])

    # persons of one clump at the same places meet others once
    links = _near(seen.select(*keys, F.col("clump").alias("p"), *places).distinct(), keys, dist, steps)
    links = links.select(*keys, F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct()
    head = "".join(f"{k} {snapshots.schema[k].dataType.simpleString()}, " for k in by)
    linked = links.groupBy(*keys).applyInPandas(join, f"{head}snap long, clump long, group long")
    whole = seen.select(*keys, "clump", "p").join(linked, [*keys, "clump"], "left").groupBy(*keys, F.coalesce("group", "clump").alias("group"))
    found = whole.agg(F.count("*").cast("int").alias("size"), F.array_sort(F.collect_list("p")).alias("members"))
    return found.where("size > 1").select(*keys, "group", "size", "members")


def recently_active(tracking: DataFrame, as_of: int, seconds: int = 90, by: Sequence[str] = ()) -> DataFrame:
    """Persons last seen on a camera within the seconds before as_of."""
    seen = tracking.where(F.col("ts_us") <= as_of).groupBy(*by, "camera_id", person_id().alias("person")).agg(F.max("ts_us").alias("last_us"))
    return seen.where(F.col("last_us") >= as_of - seconds * 1_000_000)


def join_dimensions(tracking: DataFrame, cameras: DataFrame, zones: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tracking rows with the camera's name and the zone's place in its configuration.

    Both dimensions are broadcast only under a checked size and salted beyond it.  With `by` they hold these columns too.
    """
    place, spot = F.struct(*by, "camera_id"), F.struct(*by, "camera_id", "zone")
    c = cameras.select(place.alias("_c"), F.col("name").alias("camera_name"))
    z = zones.select(spot.alias("_zc"), "zone_idx")
    out = join_dimension(tracking.withColumn("_place", place), c, "_place", "_c").drop("_c", "_place")
    return join_dimension(out.withColumn("_spot", spot), z, "_spot", "_zc").drop("_zc", "_spot")
