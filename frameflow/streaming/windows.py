"""Windowed and keyed behaviour over event streams. Every function works on a batch and on a stream alike unless it says so."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def event_time(df: DataFrame, column: str = "ts", lateness: str | None = None) -> DataFrame:
    """The column as a timestamp with time zone (a watermark needs one), with a watermark where ``lateness`` is given."""
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, lateness) if lateness else out


def tumbling(df: DataFrame, keys: list[str], length: str, slide: str | None = None, value: str = "value") -> DataFrame:
    """Counts and sums a window; sliding where ``slide`` is given."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return df.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(df: DataFrame, keys: list[str], gap: str) -> DataFrame:
    return df.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def debounce(df: DataFrame, key: str, gap: str, value: str) -> DataFrame:
    """The last value of each burst, a burst ending where ``gap`` passes without an event."""
    return df.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("at"), F.max_by(value, "ts").alias(value))


def throttle(df: DataFrame, key: str, seconds: int = 1) -> DataFrame:
    """One event a key and time bucket; on a stream within the watermark."""
    bucketed = df.withColumn("bucket", F.floor(F.unix_timestamp("ts") / seconds))
    return bucketed.dropDuplicatesWithinWatermark([key, "bucket"]) if df.isStreaming else bucketed.dropDuplicates([key, "bucket"])


def rate_limit_batch(df: DataFrame, key: str, length: str, limit: int, order: str) -> DataFrame:
    """Whether a request is among the first ``limit`` of its key and aligned window (batch)."""
    w = df.withColumn("__w", F.window("ts", length)["start"])
    return w.withColumn("allowed", F.row_number().over(Window.partitionBy(key, "__w").orderBy("ts", order)) <= limit).drop("__w")


class AnchoredWindow(StatefulProcessor):
    """A key's window starts with its first request and lasts ``seconds``; ``limit`` requests a window are allowed."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "anchor double, used int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        got = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        anchor, used = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for event_id, ts in zip(got["event_id"], got["ts"]):
            t = ts.timestamp()
            if anchor is None or t >= anchor + self.seconds:
                anchor, used = t, 0
            used += 1
            out.append((int(event_id), used <= self.limit, 0.0 if used <= self.limit else anchor + self.seconds - t))
        self.state.update((float(anchor), int(used)))
        yield pd.DataFrame({"key": [key[0]] * len(out), "event_id": [o[0] for o in out], "allowed": [o[1] for o in out], "retry_after": [o[2] for o in out]})

    def close(self) -> None:
        pass


def rate_limit(stream: DataFrame, key: str, limit: int = 10, seconds: int = 3600) -> DataFrame:
    """key, event_id, allowed and retry_after (seconds) for each request of a stream, by windows anchored at first use."""
    keyed = stream.select(F.col(key).cast("string").alias("key"), "event_id", "ts").groupBy("key")
    return keyed.transformWithStateInPandas(AnchoredWindow(limit, seconds), "key string, event_id bigint, allowed boolean, retry_after double", "append", "none")
