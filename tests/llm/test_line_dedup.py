"""Line dedup: what its plan does with all lines, and lines that very many documents share."""

from sparkloom.llm.line_dedup import boilerplate, line_dedup
from sparkloom.llm.common import table


def test_lines_are_not_sorted_before_they_are_combined(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = boilerplate(docs, "text", "source")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_common_lines_sites_and_nulls(spark):
    rows = [(i, f"common\nown {i}\n  few ", f"s{i % 9}") for i in range(400)] + [(500 + i, "four sites\nx", f"s{i}") for i in range(4)] + [(600 + i, f"five sites\ny{i}", f"t{i}") for i in range(5)]
    rows += [(700 + i, "nobody knows where\nz", None) for i in range(9)] + [(800, None, "s1"), (801, "", "s2")]
    got = {r["doc_id"]: r["clean_text"] for r in line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == f"own {i}" for i in range(400))
    assert got[500] == "four sites\nx" and got[600] == "y0" and got[700] == "nobody knows where\nz" and got[800] is None and got[801] == ""
