"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources.shared import written


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the smallest node among u and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "_u")
    return edges.join(least, F.col("u") == F.col("_u")).drop("_u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    return _lowest(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    return low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge, to a smaller v that is no u itself."""
    sides = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), (F.col("u") < F.col("v")).cast("int").alias("up")).union(edges.select("v", F.lit(0), F.lit(0)))
    nodes = sides.groupBy("x").agg(F.sum("out").alias("out"), F.count("*").alias("n"), F.sum("up").alias("up"))
    return nodes.where("up > 0 or out > 1 or (out = 1 and n > 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node with a link to another, the smallest node it reaches.

    Two stars a round, until every node hangs on its smallest one; each round is
    written, so no lineage grows.  A node's minimum is a grouped minimum, and a node
    with very many edges is split by the skew join.  Loops and null ends are left
    out; no edges give no rows.
    """
    state = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    while not _is_forest_of_stars(state):
        state = written(_small_star(_large_star(state)), "edges")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select("v", "v").distinct())
