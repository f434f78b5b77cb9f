"""Order-dependent jobs per track, person or session, with built-in windows.

`by` holds the key columns (client, store) that keep stores apart: ids of tracks
and persons are only told apart within one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import crosses_line, foot_x, person_id, side_of_line
from tracewell.sources.shared import join_dimension

TRACK = ("camera_id", "track_id")


def segment_tracks(df: DataFrame, gap: float = 30.0, keys: Sequence[str] = TRACK) -> DataFrame:
    """Add segment_id: it grows when a track was unseen for longer than `gap` seconds."""
    w = Window.partitionBy(*keys).orderBy("ts_us", "event_id")
    new = (F.col("ts_us") - F.lag("ts_us").over(w) > gap * 1e6).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("segment_id", F.sum("_new").over(w)).drop("_new")


def line_crossings(tracking: DataFrame, lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Candidate crossings: previous to current foot point of a track meets the camera's entrance line.

    kind is entry (outside to inside) or exit; the gate that drops hasty exits
    is gates.gate_crossings.  With `by`, lines hold these columns too.
    """
    w = Window.partitionBy(*by, *TRACK).orderBy("ts_us", "event_id")
    p = tracking.withColumn("fx", foot_x()).withColumn("fy", F.col("y2"))
    p = p.withColumn("px", F.lag("fx").over(w)).withColumn("py", F.lag("fy").over(w)).where("px is not null")
    place = F.struct(*by, "camera_id")
    line = lines.select(place.alias("_c"), *[F.col(x).alias(f"l{x}") for x in ("x1", "y1", "x2", "y2")], "inside_direction")
    j = join_dimension(p.withColumn("_place", place), line, "_place", "_c", "inner")
    side = lambda x, y: side_of_line(x, y, "lx1", "ly1", "lx2", "ly2") * F.when(F.col("inside_direction") == "right", -1).otherwise(1)
    before, now = side("px", "py") >= 0, side("fx", "fy") >= 0
    hit = crosses_line("px", "py", "fx", "fy", "lx1", "ly1", "lx2", "ly2") & (before != now)
    return j.where(hit).select(*by, "camera_id", "track_id", "ts_us", "event_id", F.when(now, "entry").otherwise("exit").alias("kind"))


def sample_positions(tracking: DataFrame, every: int = 5, width: int = 1920, height: int = 1080, by: Sequence[str] = ()) -> DataFrame:
    """Every 5th detection of a track, as shares of the frame."""
    w = Window.partitionBy(*by, *TRACK).orderBy("ts_us", "event_id")
    rows = tracking.withColumn("_n", F.row_number().over(w)).where(F.col("_n") % every == 0)
    return rows.select(*by, "camera_id", "track_id", "ts_us", (foot_x() / width).alias("cx"), (F.col("y2") / height).alias("cy"))


def zone_runs(tracking: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tracking rows with `person`, `zone` (blank for none), and `stop`: a number that grows where a person's zone changes."""
    w = Window.partitionBy(*by, "person").orderBy("ts_us", "event_id")
    rows = tracking.withColumn("person", person_id()).withColumn("zone", F.coalesce("zone", F.lit("")))
    return rows.withColumn("_new", (F.coalesce(F.lag("zone").over(w), F.lit("\0")) != F.col("zone")).cast("int")).withColumn("stop", F.sum("_new").over(w)).drop("_new")


def zone_stops(tracking: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stops (person, zone, cam, entry_us, exit_us) of every person; the last one is open.

    A stop lasts while the zone stays the same, whatever the camera; its camera
    is that of its last row, its end the first row of the next zone.  Blank
    zones are no stops: the stop before one is dropped, as it is never closed.
    """
    stops = zone_runs(tracking, by).groupBy(*by, "person", "stop", "zone").agg(F.min("ts_us").alias("entry_us"), F.max_by("camera_id", F.struct("ts_us", "event_id")).alias("cam"))
    s = Window.partitionBy(*by, "person").orderBy("stop")
    stops = stops.withColumn("exit_us", F.lead("entry_us").over(s)).withColumn("_next", F.lead("zone").over(s))
    return stops.where("zone <> '' and coalesce(_next, '-') <> ''").select(*by, "person", "stop", "zone", "cam", "entry_us", "exit_us")


def zone_trail(tracking: DataFrame, keep: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The last `keep` closed stops per person, and the open one."""
    stops = zone_stops(tracking, by)
    w = Window.partitionBy(*by, "person", F.col("exit_us").isNull()).orderBy(F.desc("stop"))
    return stops.withColumn("_n", F.row_number().over(w)).where(F.col("exit_us").isNull() | (F.col("_n") <= keep)).drop("_n", "stop")


def time_in_zone(tracking: DataFrame, as_of: int, by: Sequence[str] = ()) -> DataFrame:
    """Current zone of each person, and whole seconds since its entry."""
    now = zone_stops(tracking.where(F.col("ts_us") <= as_of), by).where("exit_us is null")
    return now.select(*by, "person", "zone", "entry_us", F.expr(f"({as_of} - entry_us) div 1000000").alias("seconds"))


def common_paths(positions: DataFrame, camera: str | None = None, max_paths: int = 5, min_points: int = 6, waypoints: int = 10) -> DataFrame:
    """Representative paths of the largest (start cell, end cell) clusters: rank, size, path.

    Ties go to the cluster with the smallest track; the representative is the
    member in the middle, by track.
    """
    p = positions if camera is None else positions.where(F.col("camera_id") == camera)
    # only the waypoints of a track are gathered, not its history
    p = even_sample(p.withColumn("_all", F.count("*").over(Window.partitionBy("track_id"))).where(F.col("_all") >= min_points), ["track_id"], ["ts", "id"], waypoints)
    tracks = p.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "cx", "cy"))).alias("p"))
    tracks = tracks.select("track_id", F.transform("p", lambda x: F.struct(F.bround(x["cx"], 3).alias("cx"), F.bround(x["cy"], 3).alias("cy"))).alias("path"), F.col("p")[0].alias("a"), F.element_at("p", -1).alias("z"))
    cell = lambda x: F.concat_ws(",", (F.col(f"{x}.cx") * 10).cast("int"), (F.col(f"{x}.cy") * 10).cast("int"))
    tracks = tracks.select("track_id", "path", F.concat_ws(">", cell("a"), cell("z")).alias("cluster"))
    order = Window.partitionBy("cluster").orderBy("track_id")
    members = tracks.withColumn("i", F.row_number().over(order) - 1)
    sizes = tracks.groupBy("cluster").agg(F.count("*").alias("size"), F.min("track_id").alias("first"))
    top = sizes.orderBy(F.desc("size"), "first").limit(max_paths)
    chosen = members.join(F.broadcast(top), "cluster").where(F.col("i") == F.expr("size div 2"))
    return chosen.select("cluster", "size", "first", "path")


def even_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Rows at floor(i * len / n) of each key's sequence; all of up to n."""
    w, whole = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole))
    # row i is picked if floor(j * len / n) = i for some j: j = ceil(i * n / len)
    j = F.expr(f"(_i * {n} + _n - 1) div _n")
    rows = rows.withColumn("_j", j)
    return rows.where((F.col("_n") <= n) | ((F.col("_j") < n) & (F.expr(f"(_j * _n) div {n}") == F.col("_i")))).drop("_i", "_n", "_j")


def keyframes(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 3) -> DataFrame:
    """Rows at round(i * (len - 1) / (n - 1)), both ends included (half to even); all of up to n."""
    w, whole = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (n - 1), 0).cast("long"))
    return rows.where((F.col("_n") <= n) | F.array_contains(wanted, F.col("_i").cast("long"))).drop("_i", "_n")


def dedupe_live_tracks(df: DataFrame, as_of: int, seconds: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Per global_id of the last seconds the row with most detections, the first of equals."""
    rows = df.where((F.col("ts_us") > as_of - seconds * 1e6) & (F.col("ts_us") <= as_of) & F.col("global_id").isNotNull())
    w = Window.partitionBy(*by, "global_id").orderBy(F.desc("detection_count"), "ts_us", "event_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def people_gallery(tracking: DataFrame, as_of: int, seconds: int = 120, active: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Latest row per person of the window: active ones first, then newest."""
    from tracewell.operators.traffic import latest

    rows = latest(tracking, as_of, seconds * 1_000_000, by)
    return rows.select(*by, "person", "camera_id", "zone", "ts_us", (as_of - F.col("ts_us") < active * 1_000_000).alias("active")).orderBy(*by, F.desc("active"), F.desc("ts_us"), "person")


def best_crops(crops: DataFrame, k: int = 3, gap: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Sharpest k rows of each person's current presence; a gap of over 3 seconds starts a new one.

    crops: person, ts_us, event_id, sharpness.
    """
    w = Window.partitionBy(*by, "person").orderBy("ts_us", "event_id")
    rows = crops.withColumn("_new", F.coalesce((F.col("ts_us") - F.lag("ts_us").over(w) > gap * 1e6).cast("int"), F.lit(0))).withColumn("_s", F.sum("_new").over(w))
    last = F.max("_s").over(Window.partitionBy(*by, "person"))
    best = Window.partitionBy(*by, "person").orderBy(F.desc("sharpness"), "ts_us", "event_id")
    return rows.withColumn("_last", last).where("_s = _last").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("_new", "_s", "_last")


def recent_history(exchanges: DataFrame, n: int = 6, ttl: float | None = 14_400) -> DataFrame:
    """Last n user / assistant pairs per session as an array of (role, text).

    exchanges: session, seq, role, text, and ts_us where idle time counts: the
    history restarts after more than `ttl` seconds without a row.
    """
    w = Window.partitionBy("session").orderBy("seq")
    rows = exchanges
    if ttl is not None and "ts_us" in rows.columns:
        idle = F.coalesce((F.col("ts_us") - F.lag("ts_us").over(w) > ttl * 1e6).cast("int"), F.lit(0))
        rows = rows.withColumn("_idle", idle).withColumn("_run", F.sum("_idle").over(w))
        rows = rows.withColumn("_last", F.max("_run").over(Window.partitionBy("session"))).where("_run = _last")
    rows = rows.withColumn("_r", F.lead("role").over(w)).withColumn("_t", F.lead("text").over(w)).where("role = 'user' and _r = 'assistant'")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))).where(F.col("_n") <= n)
    pair = F.struct("seq", F.col("text").alias("u"), F.col("_t").alias("a"))
    told = lambda p: F.array(F.struct(F.lit("user").alias("role"), p["u"].alias("text")), F.struct(F.lit("assistant").alias("role"), p["a"].alias("text")))
    return rows.groupBy("session").agg(F.flatten(F.transform(F.array_sort(F.collect_list(pair)), told)).alias("history"))
