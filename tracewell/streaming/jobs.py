"""Structured Streaming versions of the jobs.

Inputs are streams with `time` (timestamp) and the columns of the batch jobs.
For rows in order the results equal the batch jobs'; rows older than the
watermark are dropped, which the batch jobs never do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.functions.columns import person_id
from tracewell.sources.logs import LANDING, landing_columns
from tracewell.sources.shared import folder_of, join_dimension, new_folder  # noqa: F401

LATE = "10 minutes"


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet, and read it back."""
    spark = stream.sparkSession
    path = new_folder(spark, "stream")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def hourly_traffic(positions: DataFrame, late: str = LATE) -> DataFrame:
    """Distinct tracks per hour: exact, because (hour, track) is deduplicated before it is counted."""
    w = positions.withWatermark("time", late).select(F.window("time", "1 hour").alias("w"), "track_id")
    return w.dropDuplicates(["w", "track_id"]).groupBy("w").agg(F.count("*").alias("visitors")).select(F.col("w.start").alias("hour"), "visitors")


def presence(tracking: DataFrame, gap: str = "60 seconds", late: str = LATE, by: Sequence[str] = ()) -> DataFrame:
    """Presence sessions per person: (person, start, end, rows); a session ends after `gap` without a row."""
    s = tracking.withWatermark("time", late).groupBy(F.session_window("time", gap).alias("s"), *by, person_id().alias("person")).agg(F.count("*").alias("rows"))
    return s.select(*by, "person", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "rows")


def _sorted(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["ts_us", "event_id"], kind="stable")


def _head(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in by)


def crossings(tracking: DataFrame, lines: DataFrame, exit_cooldown: float = 8.0, late: str = LATE, by: Sequence[str] = ()) -> DataFrame:
    """Entries and gated exits per track, with its last point and crossing as state (dropped after a minute of silence).

    lines is static: `by`, camera_id, x1, y1, x2, y2, inside_direction.
    """
    from tracewell.functions.columns import foot_x, side_of_line

    place = F.struct(*by, "camera_id")
    line = lines.select(place.alias("_c"), *[F.col(x).alias(f"l{x}") for x in ("x1", "y1", "x2", "y2")], "inside_direction")
    fx, fy = foot_x(), F.col("y2")
    rows = join_dimension(tracking.withWatermark("time", late).withColumn("_place", place), line, "_place", "_c", "inner")
    sign = F.when(F.col("inside_direction") == "right", -1).otherwise(1)
    rows = rows.select(*by, "camera_id", "track_id", "time", "ts_us", "event_id", fx.alias("fx"), fy.alias("fy"), "lx1", "ly1", "lx2", "ly2", (side_of_line(fx, fy, "lx1", "ly1", "lx2", "ly2") * sign).cast("double").alias("side"))

    def meets(ax, ay, bx, by, r) -> bool:
        d = (bx - ax) * (r.ly2 - r.ly1) - (by - ay) * (r.lx2 - r.lx1)
        if abs(d) < 1e-6:
            return False
        t = ((r.lx1 - ax) * (r.ly2 - r.ly1) - (r.ly1 - ay) * (r.lx2 - r.lx1)) / d
        u = ((r.lx1 - ax) * (by - ay) - (r.ly1 - ay) * (bx - ax)) / d
        return 0 <= t <= 1 and 0 <= u <= 1

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        x, y, side, last = state.get if state.exists else (None, None, None, None)
        out, newest = [], 0
        for r in _sorted(batches).itertuples():
            if x is not None and (side >= 0) != (r.side >= 0) and meets(x, y, r.fx, r.fy, r):
                kind = "entry" if r.side >= 0 else "exit"
                if kind == "entry" or last is None or r.ts_us - last >= exit_cooldown * 1e6:
                    out.append((*key, r.ts_us, r.event_id, kind))
                    last = r.ts_us
            x, y, side, newest = r.fx, r.fy, r.side, r.ts_us
        state.update((int(x), int(y), float(side), last))
        state.setTimeoutTimestamp(max(newest // 1000 + 60_000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[*by, "camera_id", "track_id", "ts_us", "event_id", "kind"])

    return rows.groupBy(*by, "camera_id", "track_id").applyInPandasWithState(
        step, _head(tracking, by) + "camera_id string, track_id long, ts_us long, event_id long, kind string", "x int, y int, side double, last long", "append", GroupStateTimeout.EventTimeTimeout
    )


#: Parts that the persons of `zone_state` are dealt to; a checkpoint keeps to the number that it began with.  No result depends on it.
PARTS = 64


def zone_state(tracking: DataFrame, keep: int = 10, silence: str = "1 day", late: str = LATE, by: Sequence[str] = ()) -> DataFrame:
    """Closed stops (person, zone, cam, entry_us, exit_us, trail) as they close; trail: the zones of the person's
    last `keep` closed stops, this one last.

    State: the open stop and the trail of each person, given up after `silence` without a row.  A group is a part of the
    persons: one for each person would cost more than its rows.
    """
    silence_ms = int(pd.Timedelta(silence).total_seconds()) * 1000
    rows = tracking.withWatermark("time", late).select(*by, person_id().alias("person"), "time", "ts_us", "event_id", "camera_id", F.coalesce("zone", F.lit("")).alias("zone"))
    rows = rows.withColumn("part", F.expr(f"pmod(xxhash64(person), {PARTS})"))
    columns = [*by, "person", "zone", "cam", "entry_us", "exit_us", "trail"]

    def step(key, batches, state: GroupState):
        known = {p: (zone, cam, entry, trail, newest) for p, zone, cam, entry, trail, newest in json.loads(state.get[0])} if state.exists else {}
        seen, out = set(), []
        if not state.hasTimedOut:
            for r in _sorted(batches)[["person", "ts_us", "camera_id", "zone"]].itertuples(index=False, name=None):
                person, ts, camera, at = r
                zone, cam, entry, trail, _ = known.get(person, (None, None, None, [], None))
                if at != zone:
                    if zone and at:
                        trail = [*trail, zone][-keep:]
                        out.append((*key[:-1], person, zone, cam, entry, ts, trail))
                    zone, entry = at, ts
                known[person] = (zone, camera, entry, trail, ts)
                seen.add(person)
        now = state.getCurrentWatermarkMs()
        left = {p: x for p, x in known.items() if p in seen or x[4] // 1000 + silence_ms >= now}
        if left:
            state.update((json.dumps([(p, *x) for p, x in left.items()]),))
            state.setTimeoutTimestamp(max(min(x[4] for x in left.values()) // 1000 + silence_ms, now + 1))
        else:
            state.remove()
        for i in range(0, len(out), 10_000):
            yield pd.DataFrame(out[i : i + 10_000], columns=columns)

    return rows.groupBy(*by, "part").applyInPandasWithState(
        step, _head(tracking, by) + "person string, zone string, cam string, entry_us long, exit_us long, trail array<string>", "people string", "append", GroupStateTimeout.EventTimeTimeout
    )


def camera_offline(pings: DataFrame, seconds: int = 45, again: int = 900, late: str = "0 seconds", by: Sequence[str] = ()) -> DataFrame:
    """(camera_id, last_us, at_us): cameras silent for `seconds`, alerted once, then every `again` seconds of event time."""

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            last, at = state.get
            at = at if at else last + seconds * 1_000_000
            state.update((last, at + again * 1_000_000))
            state.setTimeoutTimestamp(max((at + again * 1_000_000) // 1000, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame([(*key, last, at)], columns=[*by, "camera_id", "last_us", "at_us"])
            return
        newest = max(int(b["ts_us"].max()) for b in batches)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last, 0))
        state.setTimeoutTimestamp(max((last + seconds * 1_000_000) // 1000, state.getCurrentWatermarkMs() + 1))

    rows = pings.withWatermark("time", late).select(*by, "camera_id", "time", "ts_us")
    return rows.groupBy(*by, "camera_id").applyInPandasWithState(step, _head(pings, by) + "camera_id string, last_us long, at_us long", "last long, at long", "append", GroupStateTimeout.EventTimeTimeout)


def to_landing(log: DataFrame, path: str, checkpoint: str, every: str | None = "5 minutes", ts: str = "timestamp"):
    """Append the stream under the landing folders; the checkpoint makes it exactly once."""
    w = landing_columns(log, ts).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*LANDING)
    return (w.trigger(availableNow=True) if every is None else w.trigger(processingTime=every)).start()


def on_time(rows: DataFrame, late: str = LATE) -> DataFrame:
    """(event_id, time) of rows that a watermark lets through, each once."""
    return rows.withWatermark("time", late).select("event_id", "time").dropDuplicates(["event_id", "time"])


def counted(stream: DataFrame, work, mode: str = "append") -> tuple[DataFrame, DataFrame]:
    """Run `work(stream)` over what is there: its result, and (batch, arrived, dropped) as the query itself reports them.

    arrived counts the rows that a batch read; dropped those that its stateful
    operators left out because the watermark had passed them.
    """
    spark = stream.sparkSession
    path = new_folder(spark, "stream")
    out = work(stream.observe("arrivals", F.count("*").alias("arrived")))
    query = out.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    told: dict[int, tuple[int, int]] = {}
    while True:
        over = query.awaitTermination(1)
        for p in query.recentProgress:
            arrived = p.observedMetrics.get("arrivals")
            old = told.get(p.batchId, (0, 0))
            # a batch that only moves time has no rows of its own
            told[p.batchId] = max(old[0], int(arrived["arrived"]) if arrived else 0), max(old[1], sum(o.numRowsDroppedByWatermark for o in p.stateOperators))
        if over:
            break
    batches = spark.createDataFrame([(b, *n) for b, n in sorted(told.items())], "batch long, arrived long, dropped long")
    return spark.read.schema(out.schema).parquet(f"{path}/out"), batches


def late_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(day, rows, late): rows of a batch copy of the stream per day, and those that the stream dropped."""
    k = kept.select(F.col("event_id").alias("_k")).distinct()
    d = rows.withColumn("day", F.expr("ts_us div 86400000000")).join(k, F.col("event_id") == F.col("_k"), "left")
    return d.groupBy("day").agg(F.count("*").alias("rows"), F.count(F.when(F.col("_k").isNull(), 1)).alias("late"))


EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

