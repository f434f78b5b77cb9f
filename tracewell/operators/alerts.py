"""Flagged events and alert candidates; the cooldown is gates.apply_cooldown.

`by` holds the key columns (client, store) that keep stores apart: persons,
counts and thresholds are those of one store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import person_id
from tracewell.operators.joins import camera_offline
from tracewell.operators.sequences import zone_runs

TICK_US = 5_000_000

# Seconds between two alerts of a type, and zones where waiting is normal.
COOLDOWNS = {"queue": 180.0, "capacity": 300.0, "dwell": 300.0, "loitering": 600.0, "surge": 600.0, "camera_offline": 900.0}
CHECKOUT_ZONES = ("checkout", "caixa", "caixas", "caixa_rapido", "caixa_normal", "register", "pagamento", "payment")


def list_events(events: DataFrame, camera: str | None = None, reviewed: bool | None = None, limit: int = 100) -> DataFrame:
    """Newest first, 1 to 500 of them."""
    if camera is not None:
        events = events.where(F.col("camera_id") == camera)
    if reviewed is not None:
        events = events.where(F.col("reviewed") == int(reviewed))
    return events.orderBy(F.desc("ts"), F.desc("id")).limit(max(1, min(500, limit)))


def event_state(changes: DataFrame) -> DataFrame:
    """Current events of a change log (op: flag, review or delete; seq; the event's columns)."""
    columns = [c for c in changes.columns if c not in ("op", "seq", "id", "reviewed")]
    flagged = F.when(F.col("op") == "flag", F.struct(*columns))
    state = changes.groupBy("id").agg(
        F.max_by("op", "seq").alias("op"),
        F.max_by(flagged, F.when(F.col("op") == "flag", F.col("seq"))).alias("e"),
        F.max(F.when(F.col("op") == "review", 1).otherwise(0)).alias("reviewed"),
    )
    return state.where("op <> 'delete' and e is not null").select("id", "e.*", "reviewed")


def merge_events(base: DataFrame, changes: DataFrame) -> DataFrame:
    """A snapshot after a batch of changes: flags insert or replace, reviews mark, deletes remove."""
    last = changes.groupBy("id").agg(F.max_by("op", "seq").alias("op"))
    columns = [c for c in base.columns if c != "id"]
    new = changes.where("op = 'flag'").groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("e"))
    both = base.select("id", F.struct(*columns).alias("b")).join(new, "id", "full_outer").join(last, "id", "left")
    both = both.where("op is null or op <> 'delete'").select("id", "op", F.coalesce("e", "b").alias("r")).where("r is not null")
    reviewed = F.when(F.col("op") == "review", F.lit(1)).otherwise(F.col("r.reviewed"))
    return both.select("id", *[(reviewed if c == "reviewed" else F.col(f"r.{c}")).alias(c) for c in columns])


def recent_alerts(alerts: DataFrame, n: int = 50) -> DataFrame:
    return alerts.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def dismiss(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """dismissed is set for the given ids (distinct column id)."""
    gone = ids.select(F.col("id").alias("_id")).distinct()
    return alerts.join(gone, F.col("id") == F.col("_id"), "left").withColumn("dismissed", F.coalesce("dismissed", F.lit(False)) | F.col("_id").isNotNull()).drop("_id")


def _present(tracking: DataFrame, seconds: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """(tick, person, camera_id): every person at every tick that one of their rows covers, on the newest row's camera."""
    first = F.expr(f"(ts_us + {TICK_US - 1}) div {TICK_US}")
    last = F.expr(f"(ts_us + {seconds * 1_000_000 - 1}) div {TICK_US}")
    rows = tracking.select(*by, person_id().alias("person"), "camera_id", "ts_us", "event_id").withColumn("tick", F.explode(F.sequence(first, F.greatest(first, last))))
    rows = rows.where(F.col("tick") * TICK_US - F.col("ts_us") < seconds * 1_000_000)
    return rows.groupBy(*by, "tick", "person").agg(F.max_by("camera_id", F.struct("ts_us", "event_id")).alias("camera_id"))


def _alert(df: DataFrame, kind: str, entity: Column, camera: Column, value: Column, ts: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, F.lit(kind).alias("type"), entity.alias("entity"), ts.cast("long").alias("ts_us"), camera.alias("camera_id"), value.alias("value"))


def queue_alerts(tracking: DataFrame, threshold: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """Cameras with at least `threshold` persons at a tick.  All of a store share one cooldown: the entity is empty."""
    n = _present(tracking, by=by).groupBy(*by, "tick", "camera_id").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    return _alert(n, "queue", F.lit(""), F.col("camera_id"), F.col("n"), F.col("tick") * TICK_US, by)


def queue_threshold(capacity: int | None) -> int:
    return 6 if capacity is None else max(4, capacity // 4)


def capacity_alerts(tracking: DataFrame, capacity: int = 85, by: Sequence[str] = ()) -> DataFrame:
    n = _present(tracking, by=by).groupBy(*by, "tick").agg(F.count("*").alias("n")).where(F.col("n") >= capacity)
    return _alert(n, "capacity", F.lit(""), F.lit(""), F.col("n"), F.col("tick") * TICK_US, by)


def dwell_alerts(tracking: DataFrame, minutes: int = 5, kind: str = "dwell", skip: Sequence[str] = (), by: Sequence[str] = (), seconds: int = 12) -> DataFrame:
    """A row per tick at which a person is present and has been in one zone for the minutes or longer.

    Present means that the newest row is less than `seconds` old; time in the
    zone runs from its first row, over gaps too.  Blank zones alert nobody.
    """
    rows = zone_runs(tracking, by)
    run, own = Window.partitionBy(*by, "person", "stop"), Window.partitionBy(*by, "person").orderBy("ts_us", "event_id")
    rows = rows.withColumn("entry_us", F.min("ts_us").over(run)).withColumn("_next", F.lead("ts_us").over(own)).where("zone <> ''")
    if skip:
        rows = rows.where(~F.lower("zone").isin(*skip))
    # a row stands for the person until the next one
    until = F.least(F.coalesce(F.col("_next") - 1, F.col("ts_us") + seconds * 1_000_000 - 1), F.col("ts_us") + seconds * 1_000_000 - 1)
    since = F.greatest(F.col("ts_us"), F.col("entry_us") + minutes * 60_000_000)
    rows = rows.withColumn("_since", since).withColumn("_until", until)
    rows = rows.withColumn("low", F.expr(f"(_since + {TICK_US - 1}) div {TICK_US}")).withColumn("high", F.expr(f"_until div {TICK_US}")).where("low <= high")
    rows = rows.withColumn("tick", F.explode(F.sequence("low", "high")))
    entity = F.concat(F.lit("loiter_"), F.col("person")) if kind == "loitering" else F.col("person")
    return _alert(rows, kind, entity, F.col("camera_id"), F.expr(f"(tick * {TICK_US} - entry_us) div 60000000"), F.col("tick") * TICK_US, by)


def loitering_alerts(tracking: DataFrame, minutes: int = 10, by: Sequence[str] = ()) -> DataFrame:
    return dwell_alerts(tracking, minutes, "loitering", CHECKOUT_ZONES, by)


def surge_threshold(capacity: int = 85) -> int:
    return max(5, int(0.15 * capacity))


def surge_alerts(log: DataFrame, window: int = 120, least: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Ticks with at least `least` entries in the seconds before, the tick included.

    Entries are counted per tick first; each count then reaches the ticks whose window holds it.
    """
    slots = log.where("event_type = 'entry'").groupBy(*by, F.expr(f"(ts_us + {TICK_US - 1}) div {TICK_US}").alias("slot")).agg(F.count("*").alias("n"))
    reach = slots.withColumn("tick", F.explode(F.sequence(F.col("slot"), F.col("slot") + window * 1_000_000 // TICK_US - 1)))
    n = reach.groupBy(*by, "tick").agg(F.sum("n").alias("n")).where(F.col("n") >= (surge_threshold() if least is None else least))
    return _alert(n, "surge", F.lit(""), F.lit(""), F.col("n"), F.col("tick") * TICK_US, by)


def offline_alerts(cameras: DataFrame, pings: DataFrame, as_of: int, seconds: int = 45) -> DataFrame:
    off = camera_offline(cameras, pings, as_of, seconds)
    return _alert(off, "camera_offline", F.concat(F.lit("offline_"), F.col("camera_id")), F.col("camera_id"), F.expr(f"({as_of} - last_us) div 1000000"), F.lit(as_of))


def quiet_hours(alerts: DataFrame, start: str, end: str, offset_minutes: int = 0) -> DataFrame:
    """Alerts outside the quiet hours [start, end), which may pass midnight."""
    minute = lambda t: int(t[:2]) * 60 + int(t[3:5])
    a, z = minute(start), minute(end)
    m = F.expr(f"(ts_us div 60000000 + {offset_minutes}) % 1440")
    quiet = (m >= a) & (m < z) if a <= z else (m >= a) | (m < z)
    return alerts.where(~quiet)
