"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.scratch import materialise, new_path, release, session_dir, shared_dir  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"

_remembered: dict[str, list] = {}


def claim(owner: str, *caches) -> None:
    """In a Python worker, which outlives a stage: what other operators remembered there goes; ``caches`` (with ``clear``)
    are what this one remembers."""
    for other in [o for o in _remembered if o != owner]:
        for cache in _remembered.pop(other):
            cache.clear()
    held = _remembered.setdefault(owner, [])
    held += [c for c in caches if not any(c is h for h in held)]


def forget(owner: str) -> None:
    """At a task's end: what ``owner`` remembers goes, and so does what Arrow keeps for later, so that a worker which
    waits through other stages is small."""
    import pyarrow as pa

    for cache in _remembered.get(owner, []):
        cache.clear()
    pa.default_memory_pool().release_unused()


def unused(name: str, columns: list[str]) -> str:
    """``name``, longer by as many underscores as it takes to differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str, label: str = "numbered") -> DataFrame:
    """``docs``, written once with a column ``name`` that is unique to each row."""
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), label)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body`` with ``value`` bound once: inside nested lambdas a plain column would be evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
