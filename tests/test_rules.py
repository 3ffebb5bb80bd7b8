"""The rules' queries on hand-made rows that reach every branch, against the same SQL; on the tables, see test_oracles."""

from collections import Counter

import duckdb
import pytest

from sparkloom.plans import given, more
from tests.rows import ROWS, values
from tests.test_oracles import plain


def made(spark, name):
    schema, rows = ROWS[name]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", sorted(more.RULES))
def test_rule_matches_sql_on_hand_made_rows(spark, name):
    got = more.QUERIES[name](spark, made)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    want = con.execute(given.filled(more.RULES[name], values))
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    mine, theirs = Counter(tuple(map(plain, r)) for r in got.select(columns).collect()), Counter(tuple(map(plain, r)) for r in want.fetchall())
    assert mine.total() > 0 and mine == theirs, list((mine - theirs).items())[:3] + list((theirs - mine).items())[:3]


def test_texts_worked_out_by_hand(spark):
    brief = {r["id"]: r["brief"] for r in more.brief_contexts(spark, made).collect()}
    assert brief[1] == "First sentence here is long enough to count." and brief[2] == "same other" and brief[3] == "" and brief[6] == "Short. And then a very long run of words without any other"
    ids = {r["id"]: r["event_id"] for r in more.event_ids(spark, made).collect()}
    assert ids == {1: 12, 2: 7, 3: None, 4: None, 5: 3, 6: None}
    found = {r["query"]: r["variants"] for r in more.variant_lookup(spark, made).collect()}
    assert found == {"q one": "q one,alt,other", "q two": "q two"}
