"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from chalkline.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(found):
    return sorted(tuple("" if v is None else repr(float(v)) if isinstance(v, float) else repr(v) for v in row) for row in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert rows(tuple(r[c] for c in columns) for r in frame.collect()) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
