"""The training-data queries against their SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from sparkloom.llm.queries import QUERIES
from sparkloom.llm.sql import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for n in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    want = con.execute(ORACLES[name])
    got = QUERIES[name](spark, sf_dir).select([d[0] for d in want.description])
    mine, theirs = Counter(tuple(map(str, r)) for r in got.collect()), Counter(tuple(map(str, r)) for r in want.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:2], list((theirs - mine).items())[:2])
