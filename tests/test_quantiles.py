"""Percentiles by selection against numpy, over groups, ties, wide and narrow values."""

import numpy as np
import pytest

from sparkloom.operators.quantiles import percentiles

SHARES = {"p0": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "p999": 0.999, "p100": 1.0}


@pytest.mark.parametrize("top", [1, 10, 2**16, 2**20, 2**40, 2**61])
def test_percentiles_are_those_of_numpy(spark, top):
    rng = np.random.default_rng(top % 1000)
    rows = [(g, int(v)) for g, n in (("a", 1000), ("b", 1), ("c", 2), (None, 37), ("one", 50)) for v in (rng.integers(-top, top, n) if g != "one" else np.full(n, 7))]
    df = spark.createDataFrame([*rows, ("a", None), ("nulls", None)], "k string, x long")
    got = {r["k"]: r for r in percentiles(df, ["k"], "x", SHARES).collect()}
    assert got.keys() == {"a", "b", "c", None, "one"}
    for k, r in got.items():
        values = [v for g, v in rows if g == k]
        for name, q in SHARES.items():
            assert r[name] == pytest.approx(np.percentile(np.array(values, np.longdouble), q * 100), rel=1e-12, abs=1e-9)


def test_one_group_none_and_wrong_shares(spark):
    df = spark.range(101).withColumnRenamed("id", "g")
    assert percentiles(df, (), "g", {"m": 0.5, "t": 0.105}).first().asDict() == {"m": 50.0, "t": 10.5}
    assert not percentiles(df.where("g < 0"), (), "g", {"m": 0.5}).collect()
    with pytest.raises(ValueError):
        percentiles(df, (), "g", {"m": 1.5})
    with pytest.raises(ValueError, match="span"):
        percentiles(spark.createDataFrame([(-(2**62) - 9,), (2**62,)], "v long"), (), "v", {"m": 0.5})


def test_no_aggregate_holds_a_map_of_values(spark, sf_dir):
    from sparkloom.plans import queries

    for name in ("doc_profile", "chunk_stats"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "collect" not in plan
