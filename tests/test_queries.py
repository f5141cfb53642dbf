"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(entry.core.QUERIES))
def test_query(spark, con, name):
    df = entry.core.QUERIES[name](spark, SF)
    rows = df.collect()
    columns = sorted(df.columns)
    if name in entry.core.ORACLE_SQL:
        found = con.execute(entry.core.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in found.fetchall())
        assert sorted(repr([plain(r[c]) for c in columns]) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
