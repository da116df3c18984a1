"""Which rows a model may learn from, by a checksum of their id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int) -> Column:
    """True for a remainder of 0; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 0, F.lit(False))


def learnable(doc_id: Column, folds: int) -> Column:
    """False for held-out rows and for null ids."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) != 0, F.lit(False))
