"""Matches by the index, decided in the task that scores them, against the operators that take scores as a table."""

import re

import pytest
from pyspark.sql import functions as F
from tracewell.operators import identity as V
from tracewell.operators import vector_index as N

from tests.test_matching import LOOK, found, tables


@pytest.mark.parametrize("own", [None, "vec_id"])
def test_indexed_matches_equal_tables_of_scores(spark, monkeypatch, own):
    q, x, a, g = tables(spark, 6)
    q = q.join(x.groupBy("query_id").agg(F.min_by(F.struct("camera_id", "attributes", "colour"), "ask_id").alias("l")), "query_id").select(*q.columns, "l.*")
    s = V.identity_scores(q, a, own=own).join(q.select("query_id", F.col("camera_id").alias("_c")), "query_id")
    s = s.join(g.select("gid", F.col("camera_id").alias("_d"), "recent"), "gid").withColumn("same_camera", F.col("_c") == F.col("_d"))
    want = found(V.best_match(V.with_appearance(s, q, g, LOOK).where(F.col("score") >= V.least_similarity())))
    assert len(want) > 5
    index = N.build(a, lists=5, own=own, part_rows=9)
    returned = []
    real = V.clear_best
    monkeypatch.setattr(V, "clear_best", lambda df, *rest: returned.append(df.groupBy("query_id").count().agg(F.max("count")).first()[0]) or real(df, *rest))
    lately = g.withColumn("chosen", F.col("recent"))
    got = found(N.best_matches(q, index, lately, LOOK, own=own))
    assert got == want
    # no more than two of each shelf
    assert returned[0] <= 2 * index.shelves
    assert N.best_matches(q, N.build(a.where("false"), own=own), lately, LOOK).count() == 0


def test_an_item_goes_to_few_tasks(spark, monkeypatch):
    """Queries of 20 small parts are one part, once every core has a task."""
    r = spark.range(1000).select(F.col("id").alias("gid"), F.array(F.cos(F.col("id")), F.sin(F.col("id"))).alias("embedding"))
    monkeypatch.setattr(N, "SHELF_ROWS", 100)
    monkeypatch.setattr(V, "PART_ROWS", 10)
    index = N.build(r)
    assert index.shelves > 3
    met = []
    real = N._meet
    monkeypatch.setattr(N, "_meet", lambda *a, **b: met.append(real(*a, **b)) or met[-1])
    q = r.where("gid % 5 = 0").withColumnRenamed("gid", "query_id")
    assert N.identity_scores(q, r, index, 0.9).count() > 200
    plan = met[0]._jdf.queryExecution().optimizedPlan().toString()
    dealt = re.findall(r"pmod\(xxhash64\([^)]*\), (\d+)\)", plan)
    assert dealt and set(dealt) == {"1"}
