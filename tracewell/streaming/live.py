"""Occupancy and alerts as single streaming queries of chained stateful operators.

Rows wait in the state until the watermark has passed them and are then looked
at in time order, so the order of arrival doesn't matter and nothing depends on
where batches begin.  Event-time timers move time on where no row arrives.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tracewell.functions.columns import person_id
from tracewell.operators.alerts import CHECKOUT_ZONES, TICK_US, surge_threshold
from tracewell.streaming.jobs import LATE

GONE = -1  # instead of a value: the entity is given up
#: Parts that a store's persons are dealt to; a checkpoint keeps to the number that it began with.  No result depends on it.
PARTS = 64
#: Rows of a chunk in the state, and of a frame that leaves a task.
CHUNK_ROWS = 10_000


def _packed(table: pa.Table) -> list[tuple[bytes]]:
    """The rows as chunks for a list in the state."""
    out = []
    for batch in table.combine_chunks().to_batches(max_chunksize=CHUNK_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(state, schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(bytes(r[0])).read_all() for r in state.get())])


def _keep(state, table: pa.Table) -> None:
    if len(table):
        state.put(_packed(table))
    else:
        state.clear()


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """A number for each value, null too, and the values."""
    d = column.combine_chunks().dictionary_encode(null_encoding="encode")
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _frames(columns: dict[str, object]) -> Iterator[pd.DataFrame]:
    """Columns (arrays, or one value for all) as frames of bounded size; one at least."""
    n = max((len(c) for c in columns.values() if isinstance(c, np.ndarray)), default=0)
    for i in range(0, max(n, 1), CHUNK_ROWS):
        yield pd.DataFrame({k: c[i : i + CHUNK_ROWS] if isinstance(c, np.ndarray) else np.full(min(CHUNK_ROWS, n - i), c, object) for k, c in columns.items()})


class _InOrder(StatefulProcessor):
    """Hands the rows of a part over, in time order, once the watermark has passed them.

    A subclass gives the schemas of a waiting row and of a known person (both
    with person and ts_us) and `advance`: the known persons and the rows up to
    `until` in, persons still known, frames of results and the next moment (us)
    at which something happens without a row out.  A timer fires with the
    watermark that passes its moment, so all parts look at a moment in one batch.
    """

    waiting_schema: pa.Schema
    known_schema: pa.Schema
    columns: Sequence[str]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.known = handle.getListState("known", "rows binary")
        self.start(handle)

    def start(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList(_packed(pa.Table.from_pandas(pdf, self.waiting_schema, preserve_index=False)))
                least = int(pdf["ts_us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield pd.DataFrame(columns=list(self.columns))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        until = now * 1000
        held = _unpacked(self.waiting, self.waiting_schema)
        passed = held["ts_us"].to_numpy() <= until
        rest = held.filter(pa.array(~passed))
        _keep(self.waiting, rest)
        known, out, wake = self.advance(key, _unpacked(self.known, self.known_schema), held.filter(pa.array(passed)), until)
        _keep(self.known, known)
        for ms in list(self.handle.listTimers()):
            self.handle.deleteTimer(ms)
        later = [int(t) for t in (wake, rest["ts_us"].to_numpy().min() if len(rest) else None) if t is not None]
        if later:
            self.handle.registerTimer(max(-(-min(later) // 1000), now + 1))
        yield from out

    def close(self) -> None:
        pass


class _Rows:
    """Known persons and their new rows, sorted by person and time: arrays, and where a person begins and ends."""

    def __init__(self, known: pa.Table, new: pa.Table):
        self.n = len(known) + len(new)
        self.both = pa.concat_tables([known, new], promote_options="default")
        person, self.persons = _codes(self.both["person"])
        ts = self.both["ts_us"].to_numpy()
        # a known row is older than all new ones
        event = np.concatenate([np.zeros(len(known)), new["event_id"].to_numpy()])
        self.order = np.lexsort((event, ts, np.arange(self.n) >= len(known), person))
        self.person, self.ts = person[self.order], ts[self.order]
        self.old = self.order < len(known)
        self.first = np.ones(self.n, bool)
        self.first[1:] = self.person[1:] != self.person[:-1]
        self.last = np.roll(self.first, -1)

    def codes(self, name: str) -> tuple[np.ndarray, list]:
        codes, values = _codes(self.both[name])
        return codes[self.order], values

    def numbers(self, name: str, null=0) -> np.ndarray:
        return self.both[name].fill_null(null).to_numpy()[self.order]

    def take(self, at: np.ndarray, **columns) -> pa.Table:
        """Rows as known persons, with these columns replaced."""
        t = self.both.take(pa.array(self.order[at]))
        for name, values in columns.items():
            t = t.set_column(t.column_names.index(name), name, pa.array(values[at]))
        return t


_LONG, _TEXT = pa.int64(), pa.string()


class _Presence(_InOrder):
    """Persons' cameras over time as +1 and -1 deltas: one row ends, `seconds` later, what the next one doesn't continue."""

    waiting_schema = pa.schema({"ts_us": _LONG, "event_id": _LONG, "person": _TEXT, "camera_id": _TEXT})
    known_schema = pa.schema({"ts_us": _LONG, "person": _TEXT, "camera_id": _TEXT})
    columns = ("store", "camera_id", "at_us", "delta")

    def __init__(self, seconds: float):
        self.after = int(seconds * 1e6) + 1

    def advance(self, key, known, new, until):
        r = _Rows(known, new)
        camera, names = r.codes("camera_id")
        names = np.array([*names, None], object)
        ends = np.where(r.last, r.ts + self.after, np.minimum(np.roll(r.ts, -1), r.ts + self.after))
        moved = r.last | (np.roll(camera, -1) != camera) | (np.roll(r.ts, -1) >= r.ts + self.after)
        minus = moved & (ends <= until)
        begins = r.first | np.roll(moved, 1)
        plus = begins & ~r.old
        out = {
            "store": key[0],
            "camera_id": names[np.concatenate([camera[plus], camera[minus]])],
            "at_us": np.concatenate([r.ts[plus], ends[minus]]),
            "delta": np.repeat([1, -1], [plus.sum(), minus.sum()]),
        }
        stay = r.last & (ends > until)
        kept = r.take(stay).select(self.known_schema.names)
        return kept, _frames(out), ends[stay].min() if stay.any() else None


class _RunningSum(StatefulProcessor):
    """Adds the deltas of a camera up: a row for each moment at which the number changes."""

    def init(self, handle) -> None:
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # of the frames only numbers are held
        parts = [(pdf["at_us"].to_numpy(np.int64), pdf["delta"].to_numpy(np.int8)) for pdf in rows]
        at, delta = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(at)
        at, delta = at[order], delta[order]
        starts = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
        delta = np.add.reduceat(delta, starts, dtype=np.int64)
        n = np.cumsum(delta) + (self.n.get()[0] if self.n.exists() else 0)
        self.n.update((int(n[-1]),))
        changed = delta != 0
        yield from _frames({"store": key[0], "camera_id": key[1], "at_us": at[starts][changed], "persons": n[changed]})

    def close(self) -> None:
        pass


def live_occupancy(tracking: DataFrame, seconds: float = 8, store: str = "store_id", late: str = LATE) -> DataFrame:
    """(store, camera_id, at_us, persons): exact occupancy of every camera, a row for each change.

    At any moment behind the watermark a camera's persons are those of its last
    row up to then: persons whose newest row is at most `seconds` old, each on
    the camera of that row.  State: a camera and a time per present person, in
    chunks per part of a store's persons, a number per camera.
    """
    rows = tracking.withWatermark("time", late).select(F.col(store).alias("store"), person_id().alias("person"), "time", "ts_us", "event_id", "camera_id")
    rows = rows.withColumn("part", F.expr(f"pmod(xxhash64(person), {PARTS})"))
    # all deltas behind the watermark are out in the batch that moved it, so sums need no time of their own
    deltas = rows.groupBy("store", "part").transformWithStateInPandas(_Presence(seconds), "store string, camera_id string, at_us long, delta long", "Append", "EventTime")
    return deltas.groupBy("store", "camera_id").transformWithStateInPandas(_RunningSum(), "store string, camera_id string, at_us long, persons long", "Append", "None")


class _Rules(_InOrder):
    """What a part of a store's persons and entries adds to its rules at every tick that the watermark has passed.

    Queue, capacity and surge come as numbers to be summed over the parts, dwell
    and loitering as candidates.
    """

    waiting_schema = pa.schema({"ts_us": _LONG, "event_id": _LONG, "kind": _TEXT, "person": _TEXT, "camera_id": _TEXT, "zone": _TEXT})
    known_schema = pa.schema({"ts_us": _LONG, "person": _TEXT, "camera_id": _TEXT, "zone": _TEXT, "entry_us": _LONG, "told": pa.bool_()})
    columns = ("store", "type", "entity", "ts_us", "camera_id", "value")

    def __init__(self, dwell_minutes: int, loiter_minutes: int, surge_s: int, present_s: int, skip: tuple[str, ...], silence_s: float):
        self.skip, self.dwell, self.loiter = skip, dwell_minutes * 60_000_000, loiter_minutes * 60_000_000
        self.reach, self.fresh, self.silence = -(-surge_s * 1_000_000 // TICK_US), present_s * 1_000_000, int(silence_s * 1e6)

    def start(self, handle) -> None:
        self.entries = handle.getMapState("entries", "tick long", "n long")
        self.done = handle.getValueState("done", "tick long")

    def _surge(self, ts: np.ndarray, done: int, last: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ticks, entries in the window up to each, and whether some still count at the next tick."""
        before = {k[0]: v[0] for k, v in self.entries.iterator()}
        slots = dict(before)
        for slot, n in zip(*np.unique(-(-ts // TICK_US), return_counts=True), strict=True):
            slots[int(slot)] = slots.get(int(slot), 0) + int(n)
        at = np.fromiter(slots, np.int64, len(slots))
        n = np.fromiter(slots.values(), np.int64, len(slots))
        ticks = (at[:, None] + np.arange(self.reach)).ravel()
        inside = (ticks > done) & (ticks <= last)
        found, where = np.unique(ticks[inside], return_inverse=True)
        stay = {s: m for s, m in slots.items() if s + self.reach > last + 1}
        for slot in before.keys() - stay.keys():
            self.entries.removeKey((slot,))
        for slot, m in stay.items():
            if before.get(slot) != m:
                self.entries.updateValue((slot,), (m,))
        return found, np.bincount(where, np.repeat(n, self.reach)[inside], len(found)).astype(np.int64), bool(stay)

    def advance(self, key, known, new, until):
        store, last = key[0], until // TICK_US
        done = self.done.get()[0] if self.done.exists() else (int(new["ts_us"].to_numpy().min()) if len(new) else until) // TICK_US - 1
        self.done.update((int(last),))
        kind = new["kind"].to_numpy() == "entry"
        ticks, n, counting = self._surge(new["ts_us"].to_numpy()[kind], done, last)
        out = [_frames({"store": store, "type": "surge", "entity": "", "ts_us": ticks * TICK_US, "camera_id": "", "value": n})]

        r = _Rows(known, new.filter(pa.array(~kind)).drop_columns(["kind"]))
        camera, cameras = r.codes("camera_id")
        zone, zones = r.codes("zone")
        cameras, persons = np.array([*cameras, None], object), np.array([*r.persons, None], object)
        begins = r.first | (np.roll(zone, 1) != zone)
        entry = np.where(r.old, r.numbers("entry_us"), r.ts)[np.maximum.accumulate(np.where(begins, np.arange(r.n), 0))]
        # the ticks at which a row is its person's newest, and fresh
        low = np.maximum(-(-r.ts // TICK_US), done + 1)
        until_row = np.where(r.last, r.ts + self.fresh, np.minimum(np.roll(r.ts, -1), r.ts + self.fresh))
        n = np.maximum(np.minimum((until_row - 1) // TICK_US, last) - low + 1, 0)
        row = np.repeat(np.arange(r.n), n)
        tick = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        now, stood = tick * TICK_US, tick * TICK_US - entry[row]

        seen, n = np.unique(tick * len(cameras) + camera[row], return_counts=True)
        out.append(_frames({"store": store, "type": "queue", "entity": "", "ts_us": seen // len(cameras) * TICK_US, "camera_id": cameras[seen % len(cameras)], "value": n}))
        seen, n = np.unique(now, return_counts=True)
        out.append(_frames({"store": store, "type": "capacity", "entity": "", "ts_us": seen, "camera_id": "", "value": n}))
        told = r.numbers("told", False)
        named = np.array([bool(z) for z in zones], bool)[zone[row]]
        quiet = np.array([(z or "").lower() in self.skip for z in zones], bool)[zone[row]]
        told = np.bincount(r.person, told, len(r.persons) + 1) > 0
        for name, prefix, fires in (("dwell", "", named & (stood >= self.dwell)), ("loitering", "loiter_", named & ~quiet & (stood >= self.loiter))):
            at = row[fires]
            told[r.person[at]] = True
            entities = persons[r.person[at]]
            if prefix:
                entities = np.array([f"{prefix}{p}" for p in entities], object)
            out.append(_frames({"store": store, "type": name, "entity": entities, "ts_us": now[fires], "camera_id": cameras[camera[at]], "value": stood[fires] // 60_000_000}))

        gone = r.last & (until - r.ts > self.silence)
        left = persons[r.person[gone & told[r.person]]]  # who never was a candidate has nothing to give up
        for name, prefix in (("dwell", ""), ("loitering", "loiter_")):
            entities = np.array([f"{prefix}{p}" if prefix else p for p in left], object)
            out.append(_frames({"store": store, "type": name, "entity": entities, "ts_us": until, "camera_id": "", "value": GONE}))
        stay = r.last & ~gone
        kept = r.take(stay, entry_us=entry, told=told[r.person]).select(self.known_schema.names)
        live = counting or bool((stay & ((last + 1) * TICK_US - r.ts < self.fresh)).any())
        wake = (last + 1) * TICK_US if live else int(r.ts[stay].min()) + self.silence + 1 if stay.any() else None
        return kept, (f for frames in out for f in frames if len(f)), wake


class _Cooldown(StatefulProcessor):
    """Of candidates those that fire; the state is the time of the last one of each entity, until it is given up.

    Values of a rule with a threshold are summed first: each part of the store sent its own.
    """

    def __init__(self, cooldowns: dict[str, float], thresholds: dict[str, int]):
        self.cooldowns, self.thresholds = cooldowns, thresholds

    def init(self, handle) -> None:
        self.last = handle.getMapState("last", "entity string", "ts_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        store, kind, _ = key
        names = ["entity", "ts_us", "camera_id"]
        c = pd.concat([pdf[[*names, "value"]] for pdf in rows])
        if kind in self.thresholds:
            c = c.groupby(names, dropna=False)["value"].sum().reset_index()
            c = c[c["value"] >= self.thresholds[kind]]
        gap, out, last = self.cooldowns.get(kind, 0.0) * 1e6, [], {}
        for entity, ts, camera, value in c.sort_values(["ts_us", "camera_id"], kind="stable").itertuples(index=False, name=None):
            if entity not in last:
                found = self.last.getValue((entity,))
                last[entity] = before = None if found is None else found[0]
            else:
                before = last[entity]
            if value == GONE:
                last[entity] = None
            elif before is None or ts - before >= gap and ts > before:
                last[entity] = int(ts)
                out.append((store, kind, entity, int(ts), camera if isinstance(camera, str) else None, int(value)))
        for entity, ts in last.items():
            if ts is None:
                self.last.removeKey((entity,))
            else:
                self.last.updateValue((entity,), (ts,))
        yield pd.DataFrame(out, columns=["store", "type", "entity", "ts_us", "camera_id", "value"])

    def close(self) -> None:
        pass


def alerts(
    tracking: DataFrame,
    log: DataFrame,
    cooldowns: dict[str, float],
    store: str = "store_id",
    queue: int = 6,
    capacity: int = 85,
    dwell_minutes: int = 5,
    loiter_minutes: int = 10,
    surge: int | None = None,
    surge_s: int = 120,
    present_s: int = 12,
    skip: Sequence[str] = CHECKOUT_ZONES,
    silence: str = "1 day",
    late: str = LATE,
) -> DataFrame:
    """(store, type, entity, ts_us, camera_id, value): queue, capacity, dwell, loitering and surge alerts that fire.

    One plan: rows and entrance log of a store move through its rules in parts of
    its persons, whose numbers and candidates move through thresholds and
    cooldown.  Every tick of five seconds is looked at, with or without rows, as
    soon as the watermark has passed it, by all parts in one batch; a part in
    which nobody is present has no timer.  State: camera, time, zone and entry of
    each person (given up after `silence`), entries per tick of the surge window,
    the last alert of each entity.  A part is the unit of work: no task holds
    the rows of a store, and what is summed is a number per part, tick and camera.
    """
    none = F.lit(None).cast("string")
    rows = tracking.select(F.col(store).alias("store"), "time", "ts_us", "event_id", F.lit("row").alias("kind"), person_id().alias("person"), "camera_id", F.coalesce("zone", F.lit("")).alias("zone"))
    entries = log.where("event_type = 'entry'").select(F.col(store).alias("store"), "time", "ts_us", "event_id", F.lit("entry").alias("kind"), none.alias("person"), "camera_id", none.alias("zone"))
    both = rows.unionByName(entries).withWatermark("time", late).withColumn("part", F.expr(f"pmod(coalesce(xxhash64(person), 0) + if(kind = 'entry', xxhash64(event_id), 0), {PARTS})"))
    rules = _Rules(dwell_minutes, loiter_minutes, surge_s, present_s, tuple(skip), pd.Timedelta(silence).total_seconds())
    schema = "store string, type string, entity string, ts_us long, camera_id string, value long"
    candidates = both.groupBy("store", "part").transformWithStateInPandas(rules, schema, "Append", "EventTime")
    candidates = candidates.withColumn("part", F.expr(f"pmod(xxhash64(entity), {PARTS})"))
    thresholds = {"queue": queue, "capacity": capacity, "surge": surge_threshold(capacity) if surge is None else surge}
    return candidates.groupBy("store", "type", "part").transformWithStateInPandas(_Cooldown(dict(cooldowns), thresholds), schema, "Append", "None")
