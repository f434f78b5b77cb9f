"""Counts of people: visitors, hours, zones, dwell, occupancy, crossings.

`positions` has ts in epoch milliseconds; `tracking` has ts_us in epoch
microseconds.  Every function takes the moment or the day that it is about,
and `by`: key columns (client, store) that keep stores apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import clean_zone, local_time, person_id

HOUR_MS, DAY_US = 3_600_000, 86_400_000_000


def day_bounds_ms(date: str, offset_days: int = 0, tz: str = "UTC") -> tuple[int, int]:
    """Start and end of a calendar day in epoch milliseconds (24 hours after its start)."""
    start = datetime.fromisoformat(date).replace(tzinfo=ZoneInfo(tz)) + timedelta(days=offset_days)
    ms = int(start.timestamp() * 1000)
    return ms, ms + 24 * HOUR_MS


def filter_positions(
    df: DataFrame, camera: str | None = None, gender: str | None = None, age: str | None = None, from_ts: int | None = None, to_ts: int | None = None, as_of: int | None = None
) -> DataFrame:
    """Optional predicates; None or `all` doesn't filter; without from_ts the 24 hours before as_of; to_ts is included."""
    for name, value in (("camera_id", camera), ("gender", gender), ("age_group", age)):
        if value not in (None, "all"):
            df = df.where(F.col(name) == value)
    if from_ts is None and as_of is not None:
        from_ts = as_of - 24 * HOUR_MS
    if from_ts is not None:
        df = df.where(F.col("ts") >= from_ts)
    return df if to_ts is None else df.where(F.col("ts") <= to_ts)


def filter_day(df: DataFrame, date: str, offset_days: int = 0, tz: str = "UTC", unit: int = 1, ts: str = "ts", closed: bool = False) -> DataFrame:
    """Rows of a calendar day as a range predicate; `unit` is 1 for ms, 1000 for microseconds."""
    low, high = day_bounds_ms(date, offset_days, tz)
    end = F.col(ts) <= high * unit if closed else F.col(ts) < high * unit
    return df.where((F.col(ts) >= low * unit) & end)


def _track(key: str) -> Column:
    return F.col("track_id").cast("string") if key == "track" else F.concat_ws("_", "track_id", "camera_id")


def _camera(df: DataFrame, camera: str | None) -> DataFrame:
    return df if camera is None else df.where(F.col("camera_id") == camera)


def daily_visitors(df: DataFrame, date: str, camera: str | None = None, key: str = "track", by: Sequence[str] = (), tz: str = "UTC") -> DataFrame:
    """Distinct tracks of a day."""
    day = _camera(filter_day(df, date, tz=tz), camera)
    return day.groupBy(*by).agg(F.countDistinct(_track(key)).alias("visitors"))


def visitors_by_day(df: DataFrame, key: str = "track", by: Sequence[str] = (), tz: str = "UTC", approximate: float | None = None) -> DataFrame:
    """Distinct tracks per local day; `approximate` is a relative error for fleets."""
    count = F.countDistinct(_track(key)) if approximate is None else F.approx_count_distinct(_track(key), approximate)
    return df.groupBy(*by, local_time("ts", tz).cast("date").alias("day")).agg(count.alias("visitors"))


def hourly_traffic(df: DataFrame, date: str, camera: str | None = None, fill: bool = True, by: Sequence[str] = (), tz: str = "UTC") -> DataFrame:
    """Distinct tracks per hour of the day; with `fill` all 24 hours."""
    low, _ = day_bounds_ms(date, tz=tz)
    day = _camera(filter_day(df, date, tz=tz), camera)
    hours = day.groupBy(*by, F.expr(f"cast((ts - {low}) div {HOUR_MS} as int)").alias("hour")).agg(F.countDistinct("track_id").alias("visitors"))
    if not fill:
        return hours
    grid = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    if by:
        grid = hours.select(*by).distinct().crossJoin(F.broadcast(grid))
    return grid.join(hours, [*by, "hour"], "left").select(*by, "hour", F.coalesce("visitors", F.lit(0).cast("long")).alias("visitors"))


def peak_hour(df: DataFrame, date: str, camera: str | None = None, by: Sequence[str] = (), tz: str = "UTC") -> DataFrame:
    """Busiest hour, the earliest of equals; NULL and 0 without rows."""
    hours = hourly_traffic(df, date, camera, fill=False, by=by, tz=tz)
    best = hours.groupBy(*by).agg(F.max(F.struct("visitors", (-F.col("hour")).alias("h"))).alias("b"))
    return best.select(*by, (-F.col("b.h")).alias("peak_hour"), F.coalesce("b.visitors", F.lit(0).cast("long")).alias("visitors"))


def last_window_total(df: DataFrame, as_of: int, minutes: int = 60, camera: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Distinct tracks since `minutes` before as_of (no upper end)."""
    return _camera(df.where(F.col("ts") >= as_of - minutes * 60_000), camera).groupBy(*by).agg(F.countDistinct("track_id").alias("visitors"))


def _zones(df: DataFrame, date: str, tz: str) -> DataFrame:
    day = filter_day(df, date, tz=tz, unit=1000, ts="ts_us")
    low, _ = day_bounds_ms(date, tz=tz)
    hour = F.expr(f"cast((ts_us - {low * 1000}) div 3600000000 as int)")
    return day.withColumn("zone", clean_zone()).withColumn("person", person_id()).withColumn("hour", hour).where("zone is not null")


def zone_hourly(tracking: DataFrame, date: str, by: Sequence[str] = (), tz: str = "UTC") -> DataFrame:
    """Distinct persons per zone and hour, as an array of 24 counts."""
    cells = _zones(tracking, date, tz).groupBy(*by, "zone", "hour").agg(F.countDistinct("person").alias("n"))
    held = cells.groupBy(*by, "zone").agg(F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("m"))
    return held.select(*by, "zone", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.col("m")[h], F.lit(0).cast("long"))).alias("hours"))


def zone_totals(tracking: DataFrame, date: str, by: Sequence[str] = (), tz: str = "UTC") -> DataFrame:
    return _zones(tracking, date, tz).groupBy(*by, "zone").agg(F.countDistinct("person").alias("visitors"))


def top_zone(tracking: DataFrame, date: str, by: Sequence[str] = (), tz: str = "UTC") -> DataFrame:
    """Zone with most persons; equals in name order."""
    best = zone_totals(tracking, date, by, tz).groupBy(*by).agg(F.min(F.struct((-F.col("visitors")).alias("n"), "zone")).alias("b"))
    return best.select(*by, F.col("b.zone").alias("zone"), (-F.col("b.n")).alias("visitors"))


_DIGITS = (16, 0)  # bits below each step of the selection: buckets of 65 milliseconds, then of a microsecond


def upper_median(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, median): the element at place n // 2 of each key's sorted values (whole numbers, not negative).

    A selection by digits: the values of a key are counted per bucket of their
    highest bits, the bucket that holds the place is found in these counts, and
    only its values are counted by their next bits.  No sort or window holds a
    key's values, and partial counts are made before each shuffle.
    """
    rows = values.select(*keys, F.col(value).alias("_v"), F.lit(0).cast("long").alias("_upper"))
    place = values.groupBy(*keys).agg(F.expr("count(*) div 2").alias("_place"))
    found = place.withColumn("_prefix", F.lit(0).cast("long"))
    for bits in _DIGITS:
        # a count per bucket; at most 2^16 buckets a key below 2^32
        counts = rows.groupBy(*keys, F.shiftright("_v", bits).alias("_d")).agg(F.count("*").alias("_n"))
        lists = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_d", "_n"))).alias("_counts"))
        start = F.struct(F.lit(None).cast("long").alias("d"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("upto"))
        step = lambda a, x: F.when(a["upto"] > F.col("_place"), a).otherwise(F.struct(x["_d"].alias("d"), a["upto"].alias("below"), (a["upto"] + x["_n"]).alias("upto")))
        told = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
        at = lists.join(found.select(*told, "_place"), _same(keys)).select(*keys, "_place", F.aggregate("_counts", start, step).alias("_a"))
        found = at.select(*keys, (F.col("_place") - F.col("_a.below")).alias("_place"), F.col("_a.d").alias("_prefix"))
        if bits:
            inside = _same(keys) & (F.shiftright("_v", bits) == F.col("_only"))
            rows = rows.join(found.select(*told, F.col("_prefix").alias("_only")), inside).select(*keys, "_v")
    return found.select(*keys, F.col("_prefix").alias("median"))


def _same(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return same


def dwell_by_zone(tracking: DataFrame, date: str, least: float = 0.17, most: float = 90.0, by: Sequence[str] = (), tz: str = "UTC") -> DataFrame:
    """Average and upper median of minutes per zone, over visits of `least`..`most` minutes.

    A visit is a person's first to last row in a zone, two rows at least.
    """
    visits = _zones(tracking, date, tz).groupBy(*by, "zone", "person").agg(F.count("*").alias("n"), (F.max("ts_us") - F.min("ts_us")).alias("us"))
    visits = visits.withColumn("minutes", F.col("us") / 60_000_000).where((F.col("n") >= 2) & F.col("minutes").between(least, most))
    sizes = visits.groupBy(*by, "zone").agg(F.avg("minutes").alias("mean"), F.count("*").alias("visits"))
    middle = upper_median(visits, [*by, "zone"], "us").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate((*by, "zone"))], "median")
    both = sizes.join(middle, _same((*by, "zone")))
    return both.select(*by, "zone", F.bround("mean", 1).alias("avg_minutes"), F.bround(F.col("median") / 60_000_000, 1).alias("median_minutes"), "visits").orderBy(F.desc("avg_minutes"), "zone")


def split(df: DataFrame, date: str, column: str, by: Sequence[str] = (), tz: str = "UTC") -> DataFrame:
    """Distinct (track, camera) per value of a column; the day's end is included."""
    return filter_day(df, date, tz=tz, closed=True).groupBy(*by, column).agg(F.countDistinct(_track("camera_track")).alias("visitors"))


def gender_split(df: DataFrame, date: str, **options) -> DataFrame:
    return split(df, date, "gender", **options)


def age_split(df: DataFrame, date: str, **options) -> DataFrame:
    return split(df, date, "age_group", **options)


def net_visitors(log: DataFrame, date: str, by: Sequence[str] = (), tz: str = "UTC") -> DataFrame:
    """Entries, exits, and entries less exits (not below 0)."""
    day = filter_day(log, date, tz=tz, unit=1000, ts="ts_us")
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    return day.groupBy(*by).agg(n("entry").alias("entries"), n("exit").alias("exits"), F.greatest(F.lit(0).cast("long"), n("entry") - n("exit")).alias("net"))


def entry_peak_hour(log: DataFrame, date: str, by: Sequence[str] = (), tz: str = "UTC") -> DataFrame:
    """Hour with most entries, of equals the one seen first, with its label."""
    low, _ = day_bounds_ms(date, tz=tz)
    day = filter_day(log, date, tz=tz, unit=1000, ts="ts_us").where("event_type = 'entry'")
    hours = day.groupBy(*by, F.expr(f"cast((ts_us - {low * 1000}) div 3600000000 as int)").alias("hour")).agg(F.count("*").alias("n"), F.min("ts_us").alias("seen"))
    best = hours.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "seen", "hour")).alias("b")).where("b is not null")
    h = F.lpad(F.col("b.hour").cast("string"), 2, "0")
    after = F.lpad(((F.col("b.hour") + 1) % 24).cast("string"), 2, "0")
    return best.select(*by, F.concat(h, F.lit(":00–"), after, F.lit(":00")).alias("label"), (-F.col("b.n")).alias("entries"))


def recent_entries(log: DataFrame, as_of: int, minutes: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Entries of the last minutes, newest first, per store."""
    rows = log.where((F.col("event_type") == "entry") & (F.col("ts_us") >= as_of - minutes * 60_000_000) & (F.col("ts_us") <= as_of))
    return rows.select(*by, "track_id", "camera_id", "ts_us").orderBy(*by, F.desc("ts_us"), "camera_id", "track_id")


def compare_days(df: DataFrame, date: str, by: Sequence[str] = (), tz: str = "UTC") -> DataFrame:
    """Today against yesterday in one pass."""
    low, high = day_bounds_ms(date, tz=tz)
    before, _ = day_bounds_ms(date, -1, tz)
    rows = df.where((F.col("ts") >= before) & (F.col("ts") < high))
    counts = rows.groupBy(*by).agg(
        F.countDistinct(F.when(F.col("ts") >= low, F.col("track_id"))).alias("today"), F.countDistinct(F.when(F.col("ts") < before + 24 * HOUR_MS, F.col("track_id"))).alias("yesterday")
    )
    diff = F.col("today") - F.col("yesterday")
    return counts.select(
        *by,
        "today",
        "yesterday",
        diff.alias("diff"),
        F.when(F.col("yesterday") != 0, F.bround(diff / F.col("yesterday") * 100, 1)).alias("vs_yesterday_pct"),
        F.floor(F.abs(diff) / F.greatest(F.col("yesterday"), F.lit(1)) * 100).cast("int").alias("trend_pct"),
        F.when(diff >= 0, "up").otherwise("down").alias("trend"),
    )


def density_grid(df: DataFrame, width: int = 320, height: int = 180, by: Sequence[str] = ()) -> DataFrame:
    """Rows per cell; the right and bottom edges belong to the last cells."""
    x = F.least((F.col("cx") * width).cast("int"), F.lit(width - 1)).alias("bx")
    y = F.least((F.col("cy") * height).cast("int"), F.lit(height - 1)).alias("by")
    return df.groupBy(*by, x, y).agg(F.count("*").alias("n"))


def latest(tracking: DataFrame, as_of: int, window_us: int, by: Sequence[str] = ()) -> DataFrame:
    """Last row of every person of the window [as_of - window, as_of]."""
    rows = tracking.where((F.col("ts_us") <= as_of) & (F.col("ts_us") >= as_of - window_us)).withColumn("person", person_id())
    columns = [x for x in rows.columns if x not in (*by, "person")]
    last = rows.groupBy(*by, "person").agg(F.max_by(F.struct(*columns), F.struct("ts_us", "event_id")).alias("r"))
    return last.select(*by, "person", "r.*")


def live_occupancy(tracking: DataFrame, as_of: int, seconds: int = 8, level: str = "camera", by: Sequence[str] = ()) -> DataFrame:
    """Persons last seen inside the window, per camera, zone (with percent) or store."""
    last = latest(tracking, as_of, seconds * 1_000_000, by)
    if level == "store":
        return last.groupBy(*by).agg(F.count("*").alias("persons"))
    if level == "camera":
        return last.groupBy(*by, "camera_id").agg(F.count("*").alias("persons"))
    zones = last.groupBy(*by, F.coalesce(clean_zone(), F.lit("Unknown")).alias("zone")).agg(F.count("*").alias("persons"))
    # one row per zone: the window is as large as the zone list of a store
    total = F.sum("persons").over(Window.partitionBy(*(by or [F.lit(0)])))
    return zones.withColumn("pct", F.bround(100 * F.col("persons") / total, 0).cast("int"))


def store_overview(tracking: DataFrame, cameras: DataFrame, as_of: int, seconds: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Enabled cameras with their counts (0 when absent) and the total, per store."""
    n = live_occupancy(tracking, as_of, seconds, by=by)
    on = cameras.where(F.coalesce("enabled", F.lit(True))).select(*by, "camera_id")
    zero = F.lit(0).cast("long")
    rows = on.join(n, [*by, "camera_id"], "left").select(*by, "camera_id", F.coalesce("persons", zero).alias("persons"))
    return rows.unionByName(rows.groupBy(*by).agg(F.lit("total").alias("camera_id"), F.coalesce(F.sum("persons"), zero).alias("persons")))


def fleet_health(heartbeats: DataFrame) -> DataFrame:
    """Latest row per device: active cameras (fps > 0) and the average of their fps.

    heartbeats: device, camera_id, fps, ts.
    """
    last = heartbeats.groupBy("device", "camera_id").agg(F.max_by("fps", "ts").alias("fps"))
    on = F.when(F.col("fps") > 0, F.col("fps"))
    return last.groupBy("device").agg(F.count(on).alias("cameras_active"), F.coalesce(F.bround(F.avg(on), 1), F.lit(0.0)).alias("fps_avg"))


def camera_status(heartbeats: DataFrame) -> DataFrame:
    """Latest row per device and camera: whether it is active (fps > 0), and its fps as text with one decimal."""
    last = heartbeats.groupBy("device", "camera_id").agg(F.max_by("fps", "ts").alias("fps"))
    return last.select("device", "camera_id", (F.col("fps") > 0).alias("active"), F.format_string("%.1f", F.col("fps").cast("double")).alias("fps"))


def job_metrics(jobs: DataFrame, status: str = "status", ms: str = "inference_ms") -> DataFrame:
    zero = F.lit(0.0)
    return jobs.groupBy(status).agg(
        F.count("*").alias("jobs"), F.coalesce(F.bround(F.avg(ms), 2), zero).alias("avg_ms"), F.coalesce(F.max(ms), zero).alias("max_ms"), F.coalesce(F.min(ms), zero).alias("min_ms")
    )


def clip_stats(frames: DataFrame, key: str = "track_id", ts: str = "ts_us") -> DataFrame:
    """Frames and duration (0 below two frames) of every track's clip."""
    return frames.groupBy(key).agg(F.count("*").alias("frames"), F.when(F.count("*") > 1, (F.max(ts) - F.min(ts)) / 1e6).otherwise(0.0).alias("seconds"))


def clip_summary(frames: DataFrame, key: str = "track_id", ts: str = "ts_us") -> DataFrame:
    clips = clip_stats(frames, key, ts)
    return clips.agg(F.count("*").alias("tracks"), F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"), F.coalesce(F.bround(F.avg("seconds"), 2), F.lit(0.0)).alias("avg_seconds"))


def first_zone(tracking: DataFrame, entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First known zone per track, and whole seconds since the last entry before it (0 without one)."""
    track = [*by, "camera_id", "track_id"]
    zoned = tracking.withColumn("zone", clean_zone()).where("zone is not null")
    first = zoned.groupBy(*track).agg(F.min_by(F.struct("zone", "ts_us", "gender", "age_category"), F.struct("ts_us", "event_id")).alias("f"))
    first = first.select(*track, "f.*")
    e = entries.where("event_type = 'entry'").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(track)], F.col("ts_us").alias("entry_us"))
    joined = first.join(e, _same(track) & (F.col("entry_us") <= F.col("ts_us")), "left")
    keys = [*track, "zone", "ts_us", "gender", "age_category"]
    return joined.groupBy(*keys).agg(F.coalesce(F.expr("(ts_us - max(entry_us)) div 1000000"), F.lit(0).cast("long")).alias("seconds"))


def ops_notifications(snapshot: DataFrame, teen: str = "teenager", queue: int = 3, long_rows: int = 1500, teens: int = 3, teen_share: float = 0.4, checkout: Sequence[str] = ("checkout", "caixa")) -> DataFrame:
    """One row (rule, n) per firing rule over persons (zone, age, detection_count)."""
    at_checkout = F.lit(False)
    for word in checkout:
        at_checkout = at_checkout | F.coalesce(F.lower("zone").contains(word), F.lit(False))
    n = snapshot.agg(
        F.count(F.when(at_checkout, 1)).alias("q"), F.count(F.when(F.col("detection_count") > long_rows, 1)).alias("l"), F.count(F.when(F.col("age") == teen, 1)).alias("t"), F.count("*").alias("n")
    )
    rules = n.selectExpr(f"stack(3, 'queue', q, q >= {queue}, 'long_dwell', l, l > 0, 'teen_group', t, t >= {teens} and t >= {teen_share} * n) as (rule, n, fires)")
    return rules.where("fires").select("rule", "n")


def busiest_window(df: DataFrame, date: str, window_min: int = 30, camera: str | None = None, by: Sequence[str] = (), tz: str = "UTC") -> DataFrame:
    """Most rows in any window [t - w, t] of a day; the earliest of equals.

    Rows of one millisecond are counted first.  Each is copied into its bucket
    of length w and the next, and the range frame runs within buckets: no
    window sees more than two of them, and none holds a whole day.
    """
    w = window_min * 60_000
    points = _camera(filter_day(df, date, tz=tz), camera).groupBy(*by, "ts").agg(F.count("*").alias("n"))
    own = F.expr(f"ts div {w}")
    copies = points.withColumn("bucket", F.explode(F.array(own, own + 1)))
    frame = Window.partitionBy(*by, "bucket").orderBy("ts").rangeBetween(-w, 0)
    counted = copies.withColumn("rows", F.sum("n").over(frame)).withColumn("start", F.min("ts").over(frame)).where(own == F.col("bucket"))
    best = counted.groupBy(*by).agg(F.min(F.struct((-F.col("rows")).alias("n"), "ts", "start")).alias("b"))
    clock = lambda x: F.date_format(local_time(x, tz), "HH:mm")
    return best.where("b is not null").select(*by, clock("b.start").alias("start"), clock(F.col("b.start") + w).alias("end"), (-F.col("b.n")).alias("rows"))


def dashboard(df: DataFrame, tracking: DataFrame, date: str, tz: str = "UTC") -> DataFrame:
    """One nested row for a store's day."""
    one = lambda d, name: d.agg(F.sort_array(F.collect_list(F.struct(*d.columns))).alias(name))
    first = lambda d, name: d.agg(F.first(F.struct(*d.columns)).alias(name))
    parts = [
        first(compare_days(df, date, tz=tz), "days"),
        first(peak_hour(df, date, tz=tz), "peak"),
        first(top_zone(tracking, date, tz=tz), "top_zone"),
        one(hourly_traffic(df, date, tz=tz), "hours"),
        one(zone_totals(tracking, date, tz=tz), "zones"),
        one(dwell_by_zone(tracking, date, tz=tz), "dwell"),
        one(gender_split(df, date, tz=tz), "gender"),
        one(age_split(df, date, tz=tz), "age"),
    ]
    out = parts[0]
    for p in parts[1:]:  # frames of one row each
        out = out.crossJoin(p)
    return out
