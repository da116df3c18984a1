"""Joins of two streams over a range of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_in_time(left: DataFrame, right: DataFrame, key: str, before: str, after: str, lateness: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Rows of two streams (or tables) with equal ``key`` whose times ts lie close: right's from ``before`` ahead of left's to
    ``after`` behind it, both included. Columns of the right side get the prefix right_.

    Both sides have a watermark, so their state is bounded by the range and the lateness; with how='left' a left row
    without a partner comes out once no partner can come. Rows that come after the watermark are dropped, and counted in
    the query's progress (``progress.late_rows``)."""
    other = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    if left.isStreaming:
        left, other = left.withWatermark("ts", lateness), other.withWatermark("right_ts", lateness)
    near = (F.col("right_ts") >= F.col("ts") - F.expr(f"interval {before}")) & (F.col("right_ts") <= F.col("ts") + F.expr(f"interval {after}"))
    return left.join(other, (F.col(key) == F.col(f"right_{key}")) & near, how)
