"""Every layout query against the same query in another engine, on the smallest tables."""

import duckdb
import pytest

from pagequarry.plans import registry as layout

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(layout.SQL))
def test_same_rows(spark, other, name):
    df = layout.QUERIES[name](spark, SMALL)
    got = rows(df.columns, df.collect())
    done = other.execute(layout.SQL[name])
    columns = [c[0] for c in done.description]
    assert sorted(df.columns) == sorted(columns)
    want = rows(columns, done.fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(layout.QUERIES) - set(layout.SQL)))
def test_runs(spark, name):
    assert layout.QUERIES[name](spark, SMALL).count() >= 0
