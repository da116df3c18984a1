"""All queries over the driver's tables, with their DuckDB counterparts."""

from __future__ import annotations

from frameflow.plans import q_pixels, q_sky, q_space, q_tables, registry

MODULES = (q_tables, q_sky, q_pixels, q_space)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLE)
