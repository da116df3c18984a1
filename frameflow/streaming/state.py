"""Keyed state that expires: a token blacklist by event-time timers, and a cache whose entries Spark drops after a lifetime.

Both need a state store that holds maps and timers (spark.sql.streaming.stateStore.providerClass: RocksDB). Spark offers a
lifetime of its own (TTL) by processing time only; so the blacklist, which goes by the tokens' own times, uses timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEAST_TTL = 60.0  # seconds that a revoked token stays listed, at least
SECOND = 1000


class TokenBlacklist(StatefulProcessor):
    """A user's revoked tokens, each until the token expires, or for LEAST_TTL seconds if that is longer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.revoked = handle.getMapState("revoked", "jti string", "until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        got = pd.concat(list(rows))
        got = got.assign(later=(got["kind"] != "revoke")).sort_values(["t", "later", "event_id"])  # a revocation counts at its own second
        out = []
        for event_id, kind, jti, t, exp in zip(got["event_id"], got["kind"], got["jti"], got["t"], got["exp"]):
            until = self.revoked.getValue((jti,))[0] if self.revoked.containsKey((jti,)) else None
            if kind == "revoke":
                until = max(until or 0.0, float(exp) if pd.notna(exp) else 0.0, float(t) + LEAST_TTL)
                self.revoked.updateValue((jti,), (until,))
                self.handle.registerTimer(int(until * SECOND) + 1)
            else:
                out.append((int(event_id), jti, until is not None and until > t))
        yield pd.DataFrame({"user": [key[0]] * len(out), "event_id": [o[0] for o in out], "jti": [o[1] for o in out], "blocked": [o[2] for o in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() / SECOND
        for (jti,), (until,) in list(self.revoked.iterator()):
            if until <= now:
                self.revoked.removeKey((jti,))
        yield pd.DataFrame({"user": [], "event_id": [], "jti": [], "blocked": []}).astype({"user": object, "event_id": "int64", "jti": object, "blocked": bool})

    def close(self) -> None:
        pass


def token_checks(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """user, event_id, jti and blocked for each use of a token in a stream of events (event_id, user, kind: 'revoke' or
    'use', jti, ts, exp: seconds). Events older than the watermark are dropped, and counted in the query's progress."""
    timed = events.withWatermark("ts", lateness).select(F.col("user").cast("string").alias("user"), F.col("event_id").cast("bigint").alias("event_id"), "kind", F.col("jti").cast("string").alias("jti"), "ts", F.unix_millis("ts") / 1000.0, F.col("exp").cast("double").alias("exp"))
    timed = timed.toDF("user", "event_id", "kind", "jti", "ts", "t", "exp")
    return timed.groupBy("user").transformWithStateInPandas(TokenBlacklist(), "user string, event_id bigint, jti string, blocked boolean", "append", "eventTime")


def token_checks_batch(events: DataFrame) -> DataFrame:
    """The same rule over a table: a use is blocked by a revocation at or before it that hasn't lapsed."""
    t = events.select(F.col("user").cast("string").alias("user"), F.col("event_id").cast("bigint").alias("event_id"), "kind", F.col("jti").cast("string").alias("jti"), (F.unix_millis("ts") / 1000.0).alias("t"), F.col("exp").cast("double").alias("exp"))
    until = t.where("kind = 'revoke'").select("user", "jti", F.col("t").alias("rt"), F.greatest(F.coalesce("exp", F.lit(0.0)), F.col("t") + LEAST_TTL).alias("until"))
    met = t.where("kind <> 'revoke'").join(until, ["user", "jti"], "left").groupBy("user", "event_id", "jti").agg(F.max((F.col("rt") <= F.col("t")) & (F.col("until") > F.col("t"))).alias("blocked"))
    return met.withColumn("blocked", F.coalesce("blocked", F.lit(False)))


class LivingCache(StatefulProcessor):
    """A key's entries, which Spark drops ``seconds`` after they were put."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "name string", "value string", int(self.seconds * SECOND))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        got = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, op, name, value in zip(got["seq"], got["op"], got["name"], got["value"]):
            if op == "put":
                self.entries.updateValue((name,), (value,))
            else:
                out.append((int(seq), name, self.entries.getValue((name,))[0] if self.entries.containsKey((name,)) else None))
        yield pd.DataFrame({"key": [key[0]] * len(out), "seq": [o[0] for o in out], "name": [o[1] for o in out], "value": [o[2] for o in out]})

    def close(self) -> None:
        pass


def cache_gets(operations: DataFrame, seconds: float) -> DataFrame:
    """key, seq, name and value (null: a miss) for each 'get' in a stream of operations (key, seq, op: 'put' or 'get', name,
    value); an entry lives for ``seconds`` of processing time."""
    rows = operations.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("bigint").alias("seq"), "op", "name", "value")
    return rows.groupBy("key").transformWithStateInPandas(LivingCache(seconds), "key string, seq bigint, name string, value string", "append", "processingTime")
