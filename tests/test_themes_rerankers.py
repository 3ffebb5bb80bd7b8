"""One automaton against a pattern for each alias, and a pluggable reranker: how often it is loaded, what it is given."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import rerankers, themes


def test_mentions_are_those_of_patterns(spark):
    rng = np.random.default_rng(2)
    parts = ["garden", "Party", "garden party", "été", "x_y", "9", "c++", "gardenia", "é", "été party"]
    aliases = [("a", "Garden  Party"), ("b", "garden"), ("c", "c++"), ("d", "ÉTÉ"), ("e", " "), ("f", None), (None, "party"), ("g", "party"), ("h", "garden\tparty"), ("g", "9")]
    blanks = [" ", "  ", "\n", "\t ", "", "-", "_", ". "]
    texts = [(i, "".join(x for _ in range(int(rng.integers(1, 8))) for x in (str(rng.choice(parts)), str(rng.choice(blanks))))) for i in range(400)] + [(400, None), (401, ""), (5, "garden"), (5, "garden")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in texts], "id long, text string, theme string")
    got = sorted(map(tuple, themes.theme_mentions(docs, spark.createDataFrame([(*a, 1) for a in aliases], "theme string, alias string, id int")).collect()))
    want = []
    for i, t in texts:
        hit = {n for n, a in aliases if n and a and a.strip() and re.search(r"(?<!\w)" + r"\s+".join(map(re.escape, a.lower().split())) + r"(?!\w)", (t or "").lower())}
        want += [(i, n) for n in hit]
    assert got == sorted(want) and {n for _, n in want} == {"a", "b", "c", "d", "g", "h"}
    with pytest.raises(ValueError, match="more than 2"):
        themes.theme_mentions(docs, spark.createDataFrame(aliases, "theme string, alias string"), bound=2)
    assert not themes.theme_mentions(docs, spark.createDataFrame([], "theme string, alias string")).collect()


def noted(folder):
    """A loader, whose model scores a pair by the length of its text and notes each load and each batch in a file of its own."""

    def load():
        import os
        import uuid

        class Noted:
            def __init__(self):
                open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

            def tokens(self, query, text):
                return len(query) + len(text)

            def scores(self, pairs):
                with open(f"{folder}/batch-{uuid.uuid4().hex}", "w") as f:
                    f.write(f"{len(pairs)} {max(self.tokens(*p) for p in pairs)}")
                return [float(len(t)) for _, t in pairs]

        return Noted()

    return load


def test_a_model_is_loaded_once_a_worker_and_given_batches_within_the_budget(spark, tmp_path):
    folder = str(tmp_path)
    rng = np.random.default_rng(3)
    rows = [(i % 7, i, i // 7 + 1, "q" * 10, "t" * int(rng.integers(0, 300))) for i in range(400)] + [(0, 500, 100, "q", None), (0, 501, 101, "q", "t" * 5000)]
    pairs = spark.createDataFrame(rows, "query_id long, id long, rank int, q string, t string").repartition(8)
    for _ in range(2):  # the second time, workers have it
        got = {r["id"]: r["reranker_score"] for r in rerankers.scored(pairs, "q", "t", "noted", noted(folder), 1000).collect()}
        assert got == {r[1]: float(len(r[4] or "")) for r in rows}
    names = [p.name for p in tmp_path.iterdir()]
    loads = [n.split("-")[1] for n in names if n.startswith("load")]
    assert 1 <= len(loads) == len(set(loads))  # one for each process, though each ran several tasks
    sizes = [tuple(map(int, p.read_text().split())) for p in tmp_path.iterdir() if p.name.startswith("batch")]
    assert sum(n for n, _ in sizes) == 2 * len(rows) and all(n == 1 or n * most <= 1000 for n, most in sizes)
    assert len(sizes) < len(rows)


def test_batches_take_like_sizes():
    assert list(rerankers.batches([5, 1, 5, 1, 100], 10)) == [[1, 3], [0, 2], [4]]
    assert list(rerankers.batches([], 10)) == []


def test_reranked_keeps_ranks_and_refuses_broken_scores(spark, tmp_path):
    folder = str(tmp_path)
    found = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (1, 4, 99), (2, 1, 10)], "query_id long, rank int, id long")
    texts = spark.createDataFrame([(10, "a"), (11, "bbb"), (12, "ccc")], "id long, text string")
    queries = spark.createDataFrame([(1, "q"), (2, None)], "query_id long, query_text string")
    got = rerankers.reranked(found, queries, texts, 2, "noted-2", noted(folder)).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(1, 1, 11, 2, 3.0), (1, 2, 12, 3, 3.0), (2, 1, 10, 1, 1.0)]

    def broken():
        class Broken:
            tokens = staticmethod(lambda query, text: 1)
            scores = staticmethod(lambda pairs: [float("nan")] * len(pairs))

        return Broken()

    with pytest.raises(Exception, match="no finite number"):
        rerankers.scored(found.withColumn("t", F.lit("x")), "t", "t", "broken", broken).collect()
