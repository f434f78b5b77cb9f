"""Folds whose next decision depends on the last one.

A key's rows stream through a task in order, with a state of a few values
(`sorted_scan`): the shuffle sorts and spills them, no task holds a key's rows,
however busy or unbroken it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_spaced(ts: np.ndarray, gap: float, last: float | None = None) -> np.ndarray:
    """Indexes kept of sorted times: each at least `gap` after the last kept one, and after `last`."""
    kept, i = [], 0 if last is None else int(np.searchsorted(ts, last + gap, side="left"))
    while i < len(ts):
        kept.append(i)
        i = max(i + 1, int(np.searchsorted(ts, ts[i] + gap, side="left")))
    return np.array(kept, dtype=np.int64)


def grouped_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold, schema) -> DataFrame:
    """`fold` on each key's rows in order; rows of a key must fit one task."""
    return df.groupBy(*keys).applyInPandas(lambda pdf: fold(pdf.sort_values(list(order), kind="stable")), schema)


def sorted_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], step, schema, end=None) -> DataFrame:
    """A fold that never holds a key's rows: they stream through a task in order, with a small state.

    step(state, rows) gets the next rows of a key (state None at its first ones) and gives the new
    state and rows to return, or None; end(state) gives rows once the key is over, or None.
    """

    def run(batches):
        key, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            ids = list(zip(*(pdf[k].astype(object).where(pdf[k].notna(), None) for k in keys), strict=True))
            at = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            for a, z in zip(at, [*at[1:], len(ids)], strict=True):
                if ids[a] != key:
                    if key is not None and end is not None and (out := end(state)) is not None:
                        yield out
                    key, state = ids[a], None
                state, out = step(state, pdf.iloc[a:z])
                if out is not None:
                    yield out
        if key is not None and end is not None and (out := end(state)) is not None:
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def throttle(df: DataFrame, keys: Sequence[str], ts: str, gap: float, order: Sequence[str] = ()) -> DataFrame:
    """Rows at least `gap` after the last kept row of their key (the first is kept)."""

    def step(last, pdf: pd.DataFrame):
        kept = keep_spaced(pdf[ts].to_numpy(), gap, last)
        return (pdf[ts].iloc[kept[-1]] if len(kept) else last), pdf.iloc[kept]

    return sorted_scan(df, keys, [ts, *order], step, df.schema)


def smooth(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], alpha: float = 0.35) -> DataFrame:
    """Exponential moving average per key, first row raw, cut to integers: adds <column>_smooth."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"{c}_smooth", T.IntegerType()) for c in columns)])

    def step(last, pdf: pd.DataFrame):
        out, new = {}, []
        for i, c in enumerate(columns):
            x = pdf[c].to_numpy(float).tolist()
            # value by value: other forms of the sum differ in the last bit, which the cut to integers shows
            y = list(accumulate(x, lambda s, v: alpha * v + (1 - alpha) * s, initial=None if last is None else last[i]))
            new.append(y[-1])
            out[f"{c}_smooth"] = np.trunc(y[len(y) - len(x) :]).astype("int32")
        return new, pdf.assign(**out)

    return sorted_scan(df, keys, order, step, schema)


def gate_crossings(candidates: DataFrame, exit_cooldown: float = 8.0, by: Sequence[str] = ()) -> DataFrame:
    """Crossings that count, of candidate rows (camera_id, track_id, ts_us, event_id, kind).

    An entry always counts and restarts the clock; an exit within the cooldown
    of the last crossing does not.
    """

    def step(last, pdf: pd.DataFrame):
        keep = []
        for ts, kind in zip(pdf["ts_us"], pdf["kind"], strict=True):
            ok = kind == "entry" or last is None or ts - last >= exit_cooldown * 1e6
            keep.append(ok)
            if ok:
                last = ts
        return last, pdf[keep]

    return sorted_scan(candidates, [*by, "camera_id", "track_id"], ["ts_us", "event_id"], step, candidates.schema)


def lockouts(attempts: DataFrame, most: int = 5, window: float = 300, lock: float = 900) -> DataFrame:
    """Lock intervals (ip, from_us, to_us): `most` failures within the window.

    A success or a lock resets the count; attempts during a lock don't count.
    The state is the end of the last lock and at most `most` failures.
    """

    def step(state, pdf: pd.DataFrame):
        fails, until = state or ([], -1.0)
        out = []
        for ts, ok in zip(pdf["ts_us"], pdf["ok"], strict=True):
            if ts < until:
                continue
            if ok:
                fails = []
                continue
            fails = [t for t in fails if ts - t <= window * 1e6] + [ts]
            if len(fails) >= most:
                until, fails = ts + lock * 1e6, []
                out.append((pdf["ip"].iloc[0], ts, int(until)))
        return (fails, until), pd.DataFrame(out, columns=["ip", "from_us", "to_us"])

    return sorted_scan(attempts.select("ip", "ts_us", "event_id", "ok"), ["ip"], ["ts_us", "event_id"], step, "ip string, from_us long, to_us long")


def apply_cooldown(candidates: DataFrame, cooldowns: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Alerts that fire, of candidates (type, entity, ts_us, camera_id): at most one per (type, entity) and cooldown.

    Of several candidates of one key and tick, the lowest camera_id takes part.
    Alerts of a store without an entity share one key: their candidates, one a
    tick, stream through a task.
    """
    first = candidates.groupBy(*by, "type", "entity", "ts_us").agg(F.min("camera_id").alias("camera_id"))

    def step(last, pdf: pd.DataFrame):
        kept = keep_spaced(pdf["ts_us"].to_numpy(), cooldowns.get(pdf["type"].iloc[0], 0.0) * 1e6, last)
        return (pdf["ts_us"].iloc[kept[-1]] if len(kept) else last), pdf.iloc[kept]

    return sorted_scan(first, [*by, "type", "entity"], ["ts_us"], step, first.schema)
