"""Every query against DuckDB over the same tables."""

import duckdb
import pytest

from frameflow.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return "null" if v is None else f"{v:.9g}" if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_query_equals_oracle(spark, duck, key):
    df = catalog.queries()[key](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    rel = duck.execute(catalog.oracle_sql()[key])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(r[columns.index(n)]) for n in names) for r in rel.fetchall())
    assert got == want and (got or key in ("tier_filter",))


def test_sigma_clip_has_one_exchange(spark):
    plan = catalog.queries()["stack_sigma_clip"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = catalog.queries()["name_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan
