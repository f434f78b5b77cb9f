"""Components of links: the library's stars, and pointers where links form trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.frames import cut, drop_cut
from tracewell.operators.graph import components  # noqa: F401


def roots(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node a, where every a has one link, and following links never leads back.

    Pointers double each round: a chain of n links ends after log2(n) of them.
    """
    state = cut(links.select(F.col(a).alias("node"), F.col(b).alias("root")), "roots")
    while True:
        further = state.select(F.col("node").alias("_node"), F.col("root").alias("next"))
        if state.join(further, F.col("root") == F.col("_node"), "left_semi").isEmpty():
            return state
        old, state = state, cut(state.join(further, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        drop_cut(old)
