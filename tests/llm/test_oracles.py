"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from trunkline.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = [repr([plain(v) for v in r]) for r in got.select(names).collect()]
    assert sorted(rows) == sorted(repr([plain(v) for v in r]) for r in want.fetchall())
