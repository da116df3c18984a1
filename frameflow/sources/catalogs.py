"""Sky catalogs and project files as tables. Remote catalogs are tables too: there is no network client here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECTS = "name string, ra double, dec double, kind string, mag double, size double"
SEGMENTS = "name string, ra1 double, dec1 double, ra2 double, dec2 double"

# Well-known deep-sky objects with J2000 positions in degrees and visual magnitudes.
BRIGHT_OBJECTS = (
    ("M1", 83.633, 22.014, "supernova remnant", 8.4), ("M13", 250.423, 36.461, "globular cluster", 5.8), ("M27", 299.901, 22.721, "planetary nebula", 7.5), ("M31", 10.685, 41.269, "galaxy", 3.4), ("M33", 23.462, 30.660, "galaxy", 5.7),
    ("M42", 83.822, -5.391, "nebula", 4.0), ("M45", 56.871, 24.105, "open cluster", 1.6), ("M51", 202.470, 47.195, "galaxy", 8.4), ("M57", 283.396, 33.029, "planetary nebula", 8.8), ("M81", 148.888, 69.065, "galaxy", 6.9),
    ("M101", 210.802, 54.349, "galaxy", 7.9), ("M104", 189.998, -11.623, "galaxy", 8.0),
)


def bright_objects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BRIGHT_OBJECTS, "name string, ra double, dec double, kind string, mag double")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of objects; a missing magnitude is 99, a missing size 0."""
    return spark.read.csv(path, header=True, schema=OBJECTS).na.fill({"mag": 99.0, "size": 0.0})


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SEGMENTS)


def brightest_in_cone(catalog: DataFrame, ra: float, dec: float, radius: float, max_mag: float = 15.0, limit: int = 20) -> DataFrame:
    """The remote query's form: TOP n inside the cone, brighter than a limit, by magnitude."""
    from frameflow.operators.match import cone_search

    return cone_search(catalog.where(F.col("mag") < max_mag).withColumn("k", F.col("name")), ra, dec, radius).orderBy("mag", "name").limit(limit).drop("k")


def with_fallback(local: DataFrame, online: DataFrame, least: int = 3) -> DataFrame:
    """Local objects, and online ones of other names where there are fewer than ``least`` local ones."""
    few = local.limit(least).agg((F.count(F.lit(1)) < least).alias("__few"))
    extra = online.join(local.select("name"), "name", "left_anti").dropDuplicates(["name"]).crossJoin(F.broadcast(few)).where("__few").drop("__few")
    return local.unionByName(extra, allowMissingColumns=True)


PROJECT = """version string, name string, input_frames array<struct<path:string,exposure:double,gain_iso:int,temperature:double,quality_score:double,selected:boolean,notes:string>>,
    calibration struct<dark_frames:array<string>,flat_frames:array<string>,bias_frames:array<string>>, output_path string"""


def read_projects(spark: SparkSession, path: str, major: int = 1) -> DataFrame:
    """Project files of the given major version; absent fields are null."""
    return spark.read.json(path, multiLine=True, schema=PROJECT).where(F.coalesce(F.split("version", r"\.")[0].try_cast("int"), F.lit(major)) == major)


def project_frames(projects: DataFrame) -> DataFrame:
    """One row a frame of each project; frames are selected unless they say otherwise."""
    return projects.select("name", F.posexplode("input_frames").alias("idx", "f")).select("name", "idx", "f.*").withColumn("selected", F.coalesce("selected", F.lit(True)))


def write_projects(projects: DataFrame, path: str) -> None:
    projects.write.mode("overwrite").json(path)


def read_table_response(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of a tab-separated response; lines that don't parse have nulls."""
    return lines.select(F.from_csv(column, schema, {"sep": "\t"}).alias("r")).select("r.*")


def read_name_response(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ra, dec) from a name service's lines that start with %J."""
    p = F.split(F.trim(F.col(column)), r"\s+")
    return lines.where(F.col(column).startswith("%J ")).select(p[1].try_cast("double").alias("ra"), p[2].try_cast("double").alias("dec"))
