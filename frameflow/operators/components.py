"""Connected components of graphs that are kept apart by a frame, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.scratch import materialise


def propagate(edges: DataFrame, nodes: DataFrame, rounds: int | None = None) -> DataFrame:
    """(frame_id, run, label): the smallest run number reachable over ``edges`` (frame_id, run, above)."""
    now = materialise(edges.select("frame_id", F.greatest("run", "above").alias("a"), F.least("run", "above").alias("b")).where("a > b").distinct(), "labels")
    state, k = None, 0
    while rounds is None or k < rounds:
        fresh = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("frame_id", "a", "b"), F.lit(1 << 31)))).first()
        if fresh == state:
            break
        state, k = fresh, k + 1
        both = now.selectExpr("frame_id", "a as u", "b as v").unionAll(now.selectExpr("frame_id", "b as u", "a as v"))
        least = both.groupBy("frame_id", "u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, ["frame_id", "u"]).where("v > u").selectExpr("frame_id", "v as a", "m as b").distinct()
        low = large.groupBy("frame_id", "a").agg(F.min("b").alias("m"))
        small = large.join(low, ["frame_id", "a"]).select("frame_id", F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("frame_id", "e.*").where("a > b").distinct()
        now = materialise(small, "labels")
    best = now.groupBy("frame_id", F.col("a").alias("run")).agg(F.min("b").alias("label"))
    return nodes.join(best, ["frame_id", "run"], "left").select("frame_id", "run", F.coalesce("label", "run").alias("label"))
