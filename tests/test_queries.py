import duckdb
import pytest

from strokeforge.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.SQL])
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    rel = con.sql(catalog.SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    text = lambda v: repr(v + 0.0) if isinstance(v, float) else str(v)  # noqa: E731  no negative zeros
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL])
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
