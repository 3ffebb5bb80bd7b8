"""The section that a place lies in, carried over blocks of pages, against a walk over each document; and exact splits."""

import numpy as np
import pytest

from sparkloom.operators import images, issues


@pytest.mark.parametrize("pages", [1, 3, 64])
def test_sections_are_those_of_one_walk(spark, pages):
    rng = np.random.default_rng(pages)
    marks = [(str(rng.choice(["a", "b"])), int(rng.integers(0, 40)), float(rng.integers(0, 5)), int(rng.choice([1, 2, 2])), f"t{i}") for i in range(30)]
    marks += [("a", 3, 1.0, 1, None), (None, 1, 1.0, 1, "lost"), ("c", None, 1.0, 1, "lost")]
    asked = [(str(rng.choice(["a", "b", "c"])), f"i{i}", int(rng.integers(-3, 45)), float(rng.integers(0, 5))) for i in range(120)] + [("a", "same", 9, 2.0)] * 2 + [(None, "x", 1, 1.0), ("a", "y", None, 1.0)]
    want = []
    for doc, name, page, y in asked:
        seen = sorted((m[1], m[2], m[4], m[3]) for m in marks if None not in m and m[0] == doc and page is not None and (m[1], m[2]) <= (page, y))
        main = [m for m in seen if m[3] == 1]
        want.append((doc, name, (main or seen)[-1][2] if seen else None))
    got = images.sections_of(spark.createDataFrame(asked, "doc string, image_id string, page int, y double"), spark.createDataFrame(marks, "doc string, page int, y double, level int, title string"), pages)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert len({w[2] for w in want}) > 5


def test_split_takes_the_same_share_of_each_label_to_the_row(spark):
    sizes = {"a": 1000, "b": 7, "c": 1, None: 12, "d": 2}
    rows = [(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, label string")
    got = issues.stratified(df, "label", "id").collect()
    taken = {k: sum(r["test"] for r in got if r["label"] == k) for k in sizes}
    assert taken == {k: int(n * 0.2 + 0.5) for k, n in sizes.items()} and len(got) == len(rows)
    assert {r["id"] for r in issues.stratified(df.repartition(5), "label", "id").where("test").collect()} == {r["id"] for r in got if r["test"]}
