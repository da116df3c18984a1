"""Operators that a training-data pipeline needs: deduplication, scoring, packing, sharding and search."""
