"""Streams of new frames and of cache operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def running_stack(pixels: DataFrame) -> DataFrame:
    """Sum, count and mean a place over a stream of pixels (L2 with target): the state is one row a place."""
    return pixels.groupBy("target", "ch", "y", "x").agg(F.sum("v").alias("total"), F.count("v").alias("n"), F.avg("v").alias("v"))


def frames_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of landed frames (L1) as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def upsert(batch: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``existing`` with the newest row of each key from ``batch`` put in its place."""
    columns = existing.columns
    rows = batch.select(*columns, F.lit(1).alias("__new")).unionByName(existing.select(*columns, F.lit(0).alias("__new")))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("__new", order)).alias("r"))
    return best.select("r.*")


def purge_expired(cache: DataFrame, now: float) -> DataFrame:
    """Rows whose expires_at hasn't passed."""
    return cache.where(F.col("expires_at") >= now)


def cached_lookup(cache: DataFrame, keys: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(hits with their results, the cache afterwards): expired rows go, hits count up."""
    alive = purge_expired(cache, now)
    hits = keys.select("key").join(alive, "key")
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
    after = alive.join(counted, "key", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("__n", F.lit(0))).drop("__n")
    return hits, after


def blocked_tokens(tokens: DataFrame, blacklist: DataFrame, now: float, least_ttl: float = 60.0) -> DataFrame:
    """Tokens that aren't on the blacklist; an entry lives until its token's expiry, for ``least_ttl`` seconds at least."""
    live = blacklist.where(F.greatest(F.col("exp"), F.col("added") + least_ttl) > now)
    return tokens.join(live.select("jti"), "jti", "left_anti")
