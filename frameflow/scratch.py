"""Tables that cut a plan: written to a folder that driver and executors share, and gone when the driver's process ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}  # by application, its folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, where all is one process,
    gets a temporary folder if that is unset; on a cluster executors couldn't read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = _made.get("local") or _made.setdefault("local", tempfile.mkdtemp(prefix="frameflow-"))
    return named.rstrip("/")


def _folder(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def session_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one. It is deleted when the driver's process ends."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = f"{shared_dir(spark)}/frameflow/{app}"
        files, at = _folder(spark, _made[app])
        files.mkdirs(at)
        files.deleteOnExit(at)
    return _made[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts the lineage.

    Lost executors re-read the files; nothing stays on an executor's own disk. ``release`` removes all of them.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that this application's ``materialise`` wrote; call it once the results have been stored."""
    files, at = _folder(spark, session_dir(spark))
    files.delete(at, True)
