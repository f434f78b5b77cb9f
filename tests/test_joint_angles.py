"""Joint angles as columns and as a map."""

from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.plans.registry import QUERIES


def test_angles_are_columns_and_no_map(spark):
    """The query makes no map of angles, from which each of its columns would make all six again."""
    plan = QUERIES["p15_joint_angles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan


def test_angle_of_missing_and_unsure_points(spark):
    names = C.JOINTS[next(iter(C.JOINTS))]
    rows = [(i, {n: (float(x), float(x * x), 0.9) for x, n in enumerate(names) if x != i}) for i in range(len(names) + 1)]
    rows.append((9, {n: (float(x), 0.0, 0.2) for x, n in enumerate(names)}))
    df = spark.createDataFrame(rows, "i int, points map<string, struct<x: double, y: double, conf: double>>")
    joint = next(iter(C.JOINTS))
    got = {r["i"]: (r["one"], r["all"]) for r in df.select("i", C.angle_of("points", joint).alias("one"), F.try_element_at(C.joint_angles("points"), F.lit(joint)).alias("all")).collect()}
    assert all(a == b for a, b in got.values())
    assert {i for i, (a, _) in got.items() if a is not None} == {len(names)}
