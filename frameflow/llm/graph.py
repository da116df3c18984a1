"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.llm.common import materialise

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit((1 << 31) - 1)))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b), both bigint, to a row (node, component) for each node; component is the smallest node there.

    Each round costs joins on nodes and no list of neighbours, writes its edges to the shared folder, and the edges never
    outnumber those given. Rounds grow with the logarithm of a component's size. Self loops and repeats are ignored.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    state = _state(now)
    if not state[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(MAX_ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        now = materialise(small, "edges")
        before, state = state, _state(now)
        if state == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
