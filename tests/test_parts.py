"""Streams whose unit of work is a part of a store's persons."""

import random

import pyarrow as pa
import pytest

from tracewell.plans import streams
from tracewell.sources import adapters as X
from tracewell.streaming import live as L

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("borders", [[], [40], [15, 16, 90, 91]])
def test_presence_of_a_part(borders):
    """Many persons in one group, cameras that are null too, whatever the batches."""
    rng = random.Random(5)
    rows = [(t * 1_000_000, t, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None])) for t in range(100)]
    presence, known, got = L._Presence(8), L._Presence.known_schema.empty_table(), {}
    for low, high in zip([0, *borders], [*borders, 200], strict=True):
        new = pa.Table.from_pylist([dict(zip(L._Presence.waiting_schema.names, r, strict=True)) for r in rows if low <= r[1] < high], L._Presence.waiting_schema)
        known, frames, _ = presence.advance(("s", 0), known, new, high * 1_000_000 - 1)
        for f in frames:
            for _, camera, at, delta in f.itertuples(index=False, name=None):
                got[camera, at] = got.get((camera, at), 0) + delta
    want = {}
    for person in ("a", "b", "c", None):
        own = [r for r in rows if r[2] == person]
        for r, after in zip(own, [*own[1:], None], strict=True):
            end = min(r[0] + 8_000_001, after[0] if after else 1 << 60)
            want[r[3], r[0]] = want.get((r[3], r[0]), 0) + 1
            want[r[3], end] = want.get((r[3], end), 0) - 1
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}
    assert len(known) == 0


def test_rules_of_a_part_are_summed(spark):
    """A store's rows never meet in one group: numbers of its parts are summed before a threshold is asked."""
    rules = L._Rules(5, 10, 120, 12, (), 86400.0)
    assert "queue" not in vars(rules)
    t = X.in_stores(streams.tracking(spark, SF))
    log = X.in_stores(streams.timed(X.occupancy_log(streams._Stream(spark), SF, "fast_us")))
    plan = L.alerts(t, log, {})._jdf.queryExecution().analyzed().toString()
    assert "part#" in plan and "part#" in L.live_occupancy(t)._jdf.queryExecution().analyzed().toString()
