"""Every query of the core with SQL against DuckDB on the smallest tables."""

import glob
import os

import pytest

from timberline.plans import registry


def norm(rows):
    def one(v):
        if isinstance(v, float):
            return str(round(v, 9))
        return str(round(float(v), 6)) if hasattr(v, "as_tuple") else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, small, duck, name):
    df = registry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = df.select(*[df[c] for c in cols]).collect()
    r = duck.execute(registry.oracle_sql()[name])
    have = [x[0] for x in r.description]
    assert sorted(have) == cols
    assert norm(got) == norm([[x[have.index(c)] for c in cols] for x in r.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"p4_found", "p5_found"}))
def test_runs(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_entry_point(spark, small):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "record_table"
