"""How the driver's tables stand in for frames, libraries and catalogs: the same mapping in Spark and in DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.layout import vectors_to_pixels


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def s6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


PX = """px AS (SELECT vec_id AS frame_id, label AS target, 0 AS ch, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(v AS DOUBLE) AS v
    FROM (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings))"""
UNIT = PX + ", un AS (SELECT frame_id, target, ch, y, x, least(greatest(0.5 + v, 0.0), 1.0) AS v FROM px)"
RGB = (
    UNIT
    + """, rgb AS (SELECT frame_id // 3 AS frame_id, CAST(frame_id % 3 AS INTEGER) AS ch, y, x, v FROM un
    WHERE frame_id // 3 IN (SELECT vec_id // 3 FROM embeddings GROUP BY 1 HAVING count(*) = 3))"""
)
DARK = "dark AS (SELECT y, x, median(v) AS d FROM px WHERE target = 0 GROUP BY y, x)"
FLAT = "flat AS (SELECT y, x, 1 + 0.1 * avg(v) AS f FROM px WHERE target = 1 GROUP BY y, x)"
LIGHTS = """lights AS (SELECT o_orderkey AS light_id, CAST(o_orderkey % 6 AS DOUBLE) * 60 AS exposure, CAST(100 * (o_custkey % 4) AS BIGINT) AS gain,
    CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(-10 + o_orderkey % 7 AS DOUBLE) END AS temperature, 64 AS width, 48 AS height FROM orders)"""
LIBRARY = """keys AS (SELECT s_suppkey AS k, 0 AS part FROM supplier UNION ALL SELECT p_partkey, 1 FROM part),
    lib AS (SELECT k * 2 + part AS ord, 60.0 * (k % 6) + 0.0 AS exposure, CAST(100 * (k % 4) AS BIGINT) AS gain, CAST(-10 + k % 9 AS DOUBLE) AS temperature,
    CASE k % 3 WHEN 0 THEN 'dark' WHEN 1 THEN 'flat' ELSE 'bias' END AS frame_type, '/lib/' || CAST(k % 40 AS VARCHAR) || '.fits' AS path,
    CASE WHEN k % 5 = 0 THEN 32 ELSE 64 END AS width, 48 AS height FROM keys)"""
ENTRIES = """entries AS (SELECT event_id AS idx, '/data/' || event_type || '/' || CAST(event_id AS VARCHAR) || '.fits' AS path, value AS exposure,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 1000) / 1000.0 END AS quality, event_id % 5 <> 0 AS selected,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(-20 + event_id % 30 AS DOUBLE) END AS temperature, user_id, event_type FROM events)"""
SKY = """sky AS (SELECT c_custkey AS k, fmod(c_custkey * 137.50776405, 360.0) AS ra,
    degrees(asin(2 * ((c_custkey + 0.5) / (SELECT max(c_custkey) + 1 FROM customer)) - 1)) AS dec, CAST(5 + c_custkey % 12 AS DOUBLE) AS mag FROM customer)"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return vectors_to_pixels(table(spark, sf, "embeddings"))


def unit_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).withColumn("v", F.least(F.greatest(F.col("v") + 0.5, F.lit(0.0)), F.lit(1.0)))


def rgb_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Three consecutive frames are the channels of one; incomplete ones go."""
    px = unit_pixels(spark, sf).drop("target")
    whole = table(spark, sf, "embeddings").groupBy(F.expr("vec_id div 3").alias("frame_id")).count().where("count = 3").select("frame_id")
    return px.select(F.expr("frame_id div 3").alias("frame_id"), (F.col("frame_id") % 3).cast("int").alias("ch"), "y", "x", "v").join(whole, "frame_id", "left_semi")


def dark_master(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).where("target = 0").groupBy("y", "x").agg(F.median("v").alias("d"))


def flat_master(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).where("target = 1").groupBy("y", "x").agg((1 + F.avg("v") * 0.1).alias("f"))


def lights(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("light_id"), ((F.col("o_orderkey") % 6).cast("double") * 60).alias("exposure"), (F.col("o_custkey") % 4 * 100).cast("bigint").alias("gain"),
        F.when(F.col("o_custkey") % 11 != 0, (F.col("o_orderkey") % 7 - 10).cast("double")).alias("temperature"), F.lit(64).alias("width"), F.lit(48).alias("height"),
    )


def library(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "supplier").selectExpr("s_suppkey as k", "0 as part").unionAll(table(spark, sf, "part").selectExpr("p_partkey", "1"))
    return keys.selectExpr(
        "k * 2 + part as ord", "cast(60 * (k % 6) as double) as exposure", "cast(100 * (k % 4) as bigint) as gain", "cast(-10 + k % 9 as double) as temperature",
        "case k % 3 when 0 then 'dark' when 1 then 'flat' else 'bias' end as frame_type", "concat('/lib/', k % 40, '.fits') as path", "case when k % 5 = 0 then 32 else 64 end as width", "48 as height",
    )


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id as idx", "concat('/data/', event_type, '/', event_id, '.fits') as path", "value as exposure", "case when event_id % 13 = 0 then null else (event_id % 1000) / 1000.0D end as quality",
        "event_id % 5 <> 0 as selected", "case when event_id % 7 = 0 then null else cast(-20 + event_id % 30 as double) end as temperature", "user_id", "event_type",
    )


def sky(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    n = c.agg((F.max("c_custkey") + 1).alias("n"))
    # the key times a decimal literal is a decimal in SQL: exact, and rounded once
    return c.crossJoin(F.broadcast(n)).selectExpr("c_custkey as k", "pmod(cast(cast(c_custkey as decimal(19, 0)) * 137.50776405BD as double), 360.0D) as ra", "degrees(asin(2 * ((c_custkey + 0.5D) / n) - 1)) as dec", "cast(5 + c_custkey % 12 as double) as mag")
