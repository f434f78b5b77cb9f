"""Stops of the zone stream, whose groups are parts of the persons."""

import random

from tracewell.plans import streams
from tracewell.sources import adapters as X
from tracewell.streaming import jobs as T


def test_zone_state_of_a_part(spark):
    """Persons of a part keep their own stops and trails, over batches and under clashing ids of two stores."""
    rng = random.Random(7)
    rows = [(n, f"s{rng.randrange(2)}", rng.choice([*"abcdefgh", None]), rng.choice(["u", "v", "w", "", None])) for n in range(300)]
    path = T.new_folder(spark, "rows")
    for i in range(3):
        part = [(n, X.START_US + n * 1_000_000, "camera_1", 1, p, z, s) for n, s, p, z in rows[i * 100 : i * 100 + 100]]
        spark.createDataFrame(part, "event_id long, ts_us long, camera_id string, track_id long, global_id string, zone string, store_id string").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = streams.timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    out = T.zone_state(stream, keep=3, by=["store_id"])
    assert "part#" in out._jdf.queryExecution().analyzed().toString()
    got = {(r["store_id"], r["person"], r["zone"], r["entry_us"], r["exit_us"], tuple(r["trail"])) for r in T.run_available(out).collect()}
    want, open_ = set(), {}
    for n, s, p, z in rows:
        ts, z = X.START_US + n * 1_000_000, z or ""
        zone, entry, trail = open_.get((s, p), (None, None, ()))
        if z != zone:
            if zone and z:
                trail = (*trail, zone)[-3:]
                want.add((s, p or "camera_1_1", zone, entry, ts, trail))
            zone, entry = z, ts
        open_[s, p] = zone, entry, trail
    assert got == want and len(want) > 50
