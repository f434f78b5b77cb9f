"""Matches that are decided in the task that scores them, against the operators that take scores as a table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import identity as V

AS_OF = 300_000_000
LOOK = V.Look(0, ((1, 2, 3), (2, 3, 4)), strong=0.4, least=0.8)
WORN = "attributes array<double>, colour array<double>"


def tables(spark, seed=1, alike=0.0):
    """Queries, asks, anchors and gallery with looks that lack values, identities without anchors, anchors without an identity."""
    rng, r = random.Random(seed), np.random.default_rng(seed)

    def unit():
        v = alike + r.normal(size=6)
        return [float(x) for x in v / np.linalg.norm(v)]

    def worn():
        a = rng.choice([None, [None, 0.5, 0.1, 0.9, 0.3], [0.2, None, 0.4, 0.5, 0.6], [0.0] * 5] + [[rng.random() for _ in range(5)] for _ in range(12)])
        return a, rng.choice([None, [0.3, None], [0.5], []] + [[rng.random() - 0.2, rng.random()] for _ in range(8)])

    camera = lambda: rng.choice(["a", "b", None])
    q = [(i, unit(), i) for i in range(40)]
    x = [(100 * i + j, i, camera(), *worn()) for i in range(40) for j in range(1 + i % 3)]
    a = [(g, unit(), 1000 + 10 * g + j if j else g) for g in range(33) for j in range(g % 5)]
    g = [(g, camera(), rng.randrange(AS_OF // 2, AS_OF + 1), rng.choice([True, False, False, None]), g % 3 == 0, *worn()) for g in range(3, 36)]
    return (
        spark.createDataFrame(q, "query_id long, embedding array<double>, vec_id long"),
        spark.createDataFrame(x, f"ask_id long, query_id long, camera_id string, {WORN}"),
        spark.createDataFrame(a, "gid long, embedding array<double>, vec_id long"),
        spark.createDataFrame(g, f"gid long, camera_id string, last_us long, assigned boolean, recent boolean, {WORN}"),
    )


def found(df):
    return sorted((r[0], r.gid, round(r.score, 9)) for r in df.select(df.columns[0], "gid", "score").collect())


@pytest.mark.parametrize("own", [None, "vec_id"])
def test_decided_in_tasks_equal_tables_of_scores(spark, own):
    q, x, a, g = tables(spark)
    asked = x.select(F.col("ask_id").alias("query_id"), "camera_id", "attributes", "colour")
    s = V.identity_scores(q, a, own=own).join(x.select("query_id", "ask_id", F.col("camera_id").alias("_c")), "query_id").drop("query_id").withColumnRenamed("ask_id", "query_id")
    s = s.join(g.select("gid", F.col("camera_id").alias("_d"), "recent"), "gid").withColumn("same_camera", F.col("_c") == F.col("_d"))
    s = V.with_appearance(s, asked, g, LOOK).cache()
    match = found(V.best_match(s.where(F.col("score") >= V.least_similarity())))
    rescue = found(V.rescue_match(s.drop("recent"), g.where("recent")))
    closed = found(V.closed_world_match(s.drop("_c", "_d", "same_camera"), asked, g, AS_OF, look=LOOK))
    assert len(match) > 5 and len(rescue) > 5 and len(closed) > 5
    lately, pool = g.withColumn("chosen", F.col("recent")), g.withColumn("chosen", V.closed_pool(AS_OF))
    for sizes in ({}, {"block_rows": 9, "part_rows": 7}):
        assert found(V.best_matches(q, x, a, lately, LOOK, own=own, **sizes)) == match
        assert found(V.rescue_matches(q, x, a, lately, LOOK, own=own, **sizes)) == rescue
        assert found(V.closed_world_matches(q, x, a, pool, LOOK, own=own, **sizes)) == closed
    assert found(V.best_matches(q, x, a.where("false"), lately, LOOK)) == []


def test_assignment_passes_on_no_pairs(spark, monkeypatch):
    """All tracks are like all identities: a task still returns at most two of them for each row that asks."""
    q, _, a, g = tables(spark, 2, alike=3.0)
    tracks = q.select(F.lit("a").alias("camera_id"), F.col("query_id").alias("track_id"), F.col("query_id").alias("ts"), "embedding", F.lit(1.0).alias("sharpness"), F.lit(None).cast("array<double>").alias("attributes"), F.lit(None).cast("array<double>").alias("colour"))
    returned = []

    def counted(name):
        real = getattr(V, name, None)

        def run(*args, **kwargs):
            out = real(*args, **kwargs)
            most = out.groupBy(out.columns[0]).count().agg(F.max("count")).first()[0]
            returned.append(most or 0)
            return out

        monkeypatch.setattr(V, name, run, raising=False)

    counted("identity_scores")
    counted("judged")
    held = spark.createDataFrame([], "camera_id string, gid long, track_id long, ts_us long")
    got = V.assign_identities(tracks, a, g, held, g.where("recent").select("gid"), AS_OF, LOOK).collect()
    assert len(got) == 40 and returned and max(returned) == 2
