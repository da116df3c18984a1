"""Progress of streams and batches as tables: frames a second, what remains, and rows that came too late."""

from __future__ import annotations

import threading
from collections import deque
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, run string, batch bigint, at timestamp, rows bigint, seconds double, late bigint, observed map<string,double>"


class ProgressLog(StreamingQueryListener):
    """Keeps a row for each batch of every query of a session, the last ``keep`` of them. Add it by ``watch``."""

    def __init__(self, keep: int = 10_000):
        self.kept: deque = deque(maxlen=keep)
        self.ended: dict[str, str | None] = {}
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seconds = float((p.durationMs or {}).get("triggerExecution", 0)) / 1000
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        observed = {f"{name}.{k}": float(v) for name, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items() if isinstance(v, (int, float))}
        at = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        with self.lock:
            self.kept.append((p.name or str(p.id), str(p.runId), int(p.batchId), at, int(p.numInputRows), seconds, int(late), observed))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.lock:
            self.ended[str(event.runId)] = event.exception

    def table(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(list(self.kept), SCHEMA)


def watch(spark: SparkSession, keep: int = 10_000) -> ProgressLog:
    log = ProgressLog(keep)
    spark.streams.addListener(log)
    return log


def throughput(log: DataFrame, total: int | None = None, last: int = 5) -> DataFrame:
    """Per query and batch with rows: rows done so far, rows a second of this batch and over the last five, what remains of
    ``total`` and the seconds that it takes at that rate. A query's batches are few; its rows are counted, not held."""
    by = Window.partitionBy("query").orderBy("batch")
    recent = by.rowsBetween(1 - last, 0)
    once = log.where("rows > 0").groupBy("query", "batch").agg(F.max_by("rows", "at").alias("rows"), F.max_by("seconds", "at").alias("seconds"), F.max("late").alias("late"))
    done = once.withColumns({"done": F.sum("rows").over(by.rowsBetween(Window.unboundedPreceding, 0)), "rate": F.col("rows") / F.greatest("seconds", F.lit(1e-3)), "recent_rate": F.sum("rows").over(recent) / F.greatest(F.sum("seconds").over(recent), F.lit(1e-3))})
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0)) if total is not None else F.lit(None).cast("bigint")
    return done.withColumn("remaining", left).withColumn("eta_seconds", F.col("remaining") / F.col("recent_rate"))


def late_rows(log: DataFrame) -> DataFrame:
    """Per query: how many rows its state dropped because they came after the watermark."""
    return log.groupBy("query", "batch").agg(F.max("late").alias("late")).groupBy("query").agg(F.sum("late").alias("late"))


def measured(frames: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation | str]:
    """``frames`` with metrics that are gathered while they pass (the number of rows, and those given): an Observation whose
    ``get`` has them after the action, or on a stream the name under which they are in its progress."""
    columns = [F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in metrics.items()]]
    if frames.isStreaming:
        return frames.observe(name, *columns), name
    seen = Observation(name)
    return frames.observe(seen, *columns), seen
