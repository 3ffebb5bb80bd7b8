"""Every query with SQL against DuckDB on the same tables, rows compared as sets with their number."""

import math
from collections import Counter

import duckdb
import pytest

from sparkloom.plans import live, more, queries, sql
from sparkloom.sources.tables import NAMES

QUERIES, ORACLES = queries.QUERIES | more.QUERIES | live.QUERIES, sql.ORACLES | more.ORACLES | live.ORACLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(int(v)) if isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    mine = Counter(tuple(map(plain, r)) for r in got.select(columns).collect())
    theirs = Counter(tuple(map(plain, r)) for r in want.fetchall())
    assert mine.total() == theirs.total() and not (mine - theirs), list((mine - theirs).items())[:3] + list((theirs - mine).items())[:3]
    assert mine.total() > 0


def test_queries_without_sql_are_those_with_brute_force_tests():
    assert set(QUERIES) - set(ORACLES) == {"chunk_recursive", "chunk_structure", "issue_classifier", "application_decisions", "event_leaders", "clothes_left", "near_image_groups", "chunk_semantic"}
