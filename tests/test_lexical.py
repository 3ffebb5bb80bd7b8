"""The stored lexical index against weights worked out here: tiles, buckets, sets of queries, what is read and what is left out."""

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import lexical, retrieval
from sparkloom.operators.lexical import build_index, search_index, stored_index
from sparkloom.sources import shared

RNG = random.Random(5)
COMMON, RARE = "the ab bc zz yy".split(), "cd de ef fg gh Été x1 The".split()


def some(n):
    return " ".join(RNG.choice(RARE if RNG.random() < 0.2 else COMMON) for _ in range(n))


TEXTS = {i: some(RNG.randrange(1, 30)) for i in range(40)} | {40: None, 41: "", 42: "!!", 43: "the ab bc", 44: "the ab bc"}
ASKED = {i: some(RNG.randrange(1, 6)) for i in range(17)} | {17: None, 18: "", 19: "nobody says this"}


def bag(*texts):
    found = {}
    for t in texts:
        words = re.findall(r"\w{2,}", (t or "").lower())
        for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            found[x] = found.get(x, 0) + 1
    return found


def expected(bags, asked, k=5):
    idf = {x: math.log((1 + len(bags)) / (1 + sum(x in b for b in bags.values()))) + 1 for x in set().union(*bags.values())}

    def unit(b):
        w = {x: (1 + math.log(c)) * idf[x] for x, c in b.items() if x in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / norm for x, v in w.items()}

    vectors, want = {i: unit(b) for i, b in bags.items()}, {}
    for q, t in asked.items():
        v = unit(bag(t))
        best = sorted((-round(sum(x * vectors[i].get(y, 0) for y, x in v.items()), 9), i) for i in bags)
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate((b for b in best if b[0] < 0), 1) if n <= k}
    return want


def same(found, want):
    got = {(r.query_id, r.rank): (r.id, r.score) for r in found.collect()}
    assert {key: s for key, (_, s) in got.items()} == pytest.approx({key: s for key, (_, s) in want.items()}, abs=2e-9)
    assert {key: i for key, (i, _) in got.items()} == {key: i for key, (i, _) in want.items()}


def frames(spark, texts, asked):
    return spark.createDataFrame(list(texts), "id long, text string"), spark.createDataFrame(list(asked), "query_id long, text string")


@pytest.mark.parametrize(("tile", "buckets"), [(4096, 64), (7, 3), (1, 1)])
def test_search_equals_brute_force(spark, tmp_path, tile, buckets):
    docs, queries = frames(spark, TEXTS.items(), ASKED.items())
    build_index(spark, docs.repartition(3), str(tmp_path / "index"), tile, buckets)
    same(search_index(spark, str(tmp_path / "index"), queries, 5), expected({i: bag(t) for i, t in TEXTS.items()}, ASKED))


def test_queries_in_sets(spark, tmp_path, monkeypatch):
    docs, queries = frames(spark, TEXTS.items(), ASKED.items())
    build_index(spark, docs, str(tmp_path / "index"), 9, 4)
    monkeypatch.setattr(lexical, "ENTRIES", 11)
    same(search_index(spark, str(tmp_path / "index"), queries, 3), expected({i: bag(t) for i, t in TEXTS.items()}, ASKED, 3))


def test_repeated_and_missing_ids(spark, tmp_path):
    """Rows of one id are one text; a row without an id is in no result."""
    rows = [*list(TEXTS.items())[:20], (3, "ab ab extra words"), (3, None), (None, "the ab bc")]
    bags = {i: bag(*(t for j, t in rows if j == i)) for i, _ in rows if i is not None}
    docs, queries = frames(spark, rows, ASKED.items())
    build_index(spark, docs, str(tmp_path / "index"), 5, 4)
    same(search_index(spark, str(tmp_path / "index"), queries, 5), expected(bags, ASKED))


def test_empty_tables(spark, tmp_path):
    docs, queries = frames(spark, TEXTS.items(), ASKED.items())
    build_index(spark, docs.where("id < 0"), str(tmp_path / "none"))
    assert not search_index(spark, str(tmp_path / "none"), queries, 5).collect()
    build_index(spark, docs, str(tmp_path / "index"))
    assert not search_index(spark, str(tmp_path / "index"), queries.where("query_id < 0"), 5).collect()
    with pytest.raises(ValueError):
        search_index(spark, str(tmp_path / "index"), queries, 0)


def test_only_buckets_of_the_terms_are_read(spark, tmp_path):
    docs, _ = frames(spark, ((i, f"w{i} w{i + 1} w{i + 2}") for i in range(500)), [])
    build_index(spark, docs, str(tmp_path / "index"), 50, 32)
    found = search_index(spark, str(tmp_path / "index"), frames(spark, [], [(1, "w7")])[1], 5)
    assert {r.id for r in found.collect()} == {5, 6, 7}
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in re.findall(r"PartitionFilters: \[(.*?)\]", plan) if "bucket" in x]
    assert filters and all(re.search(r"\(bucket#\d+ = \d+\)", f) for f in filters)  # one bucket of 32


def test_tiles_that_can_not_come_in_are_left_out():
    row = lambda ids, w: (np.array(ids), np.array(w), max(w))
    queries, best = [(1, [10, 20], [0.8, 0.6]), (2, [20], [1.0])], {}
    assert lexical._search_tile({10: row([1, 2], [0.9, 0.8]), 20: row([2, 3], [0.5, 0.5])}, queries, best, 2) == 2
    assert best[1][0].tolist() == [2, 1] and best[2][0].tolist() == [2, 3]
    assert lexical._search_tile({10: row([8], [0.2]), 20: row([9], [0.5])}, queries, best, 2) == 1  # 0.46 can't reach 0.72; a tie of the second has to be looked at
    assert best[2][0].tolist() == [2, 3] and best[1][0].tolist() == [2, 1]


def test_index_is_built_once_for_the_same_files(spark, tmp_path, monkeypatch):
    docs, _ = frames(spark, TEXTS.items(), [])
    docs.write.parquet(str(tmp_path / "docs"))
    built, build = [], lexical.build_index
    monkeypatch.setattr(lexical, "build_index", lambda *a: (built.append(a[2]), build(*a)))
    first = stored_index(spark, spark.read.parquet(str(tmp_path / "docs")))
    assert stored_index(spark, spark.read.parquet(str(tmp_path / "docs"))) == first and len(built) == 1
    docs.limit(1).write.mode("append").parquet(str(tmp_path / "docs"))
    assert stored_index(spark, spark.read.parquet(str(tmp_path / "docs"))) != first and len(built) == 2
    # a writer that died left files but no manifest
    shared.delete(spark, f"{first}/manifest.json")
    docs.write.mode("overwrite").parquet(str(tmp_path / "docs"))
    again = stored_index(spark, spark.read.parquet(str(tmp_path / "docs")))
    assert shared.exists(spark, f"{again}/manifest.json") and len(built) == 3


def test_publishing_is_won_once(spark, tmp_path):
    at = str(tmp_path / "m.json")
    assert shared.publish(spark, at, "é one") and not shared.publish(spark, at, "two")
    assert shared.read_text(spark, at) == "é one" and shared.names(spark, str(tmp_path)) == [".m.json.crc", "m.json"] or shared.read_text(spark, at) == "é one"
    assert shared.names(spark, str(tmp_path / "nothing")) == []


def test_vectors_that_are_null_zero_or_broken_take_no_part(spark):
    from sparkloom.operators import retrieval

    good = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])]
    bad = [(4, None), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0])]
    rows = spark.createDataFrame(good + bad, "id long, v array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (9, None), (10, [0.0, 0.0])], "query_id long, v array<double>")
    got = [(r.query_id, r.rank, r.id) for r in retrieval.dense_topk(queries, rows, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    with pytest.raises(Exception, match="one length"):
        retrieval.dense_topk(queries, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>").coalesce(1), 3).collect()
    sections = rows.select("id", F.lit("s").alias("section"), F.col("v").alias("stage1"), F.col("v").alias("full"))
    asked = queries.select("query_id", F.col("v").alias("stage1"), F.col("v").alias("full"))
    assert {r.id for r in retrieval.gated_search(asked, sections, 3, 3).collect()} == {1, 2, 3}


@pytest.mark.parametrize("gated", [False, True])
def test_pairs_of_tiles_are_not_copied_by_the_batch(gated):
    """Memory of a batch with many pairs stays that of one pair; sections decide as they did."""
    rng, n, pairs = np.random.default_rng(3), 128, 200
    x = [rng.standard_normal((n, 64)) for _ in range(2)]
    tile = lambda at, shift: ([list(range(shift, shift + n))] * pairs, [[None if i % 9 == 0 else f"s{i % 4}" for i in range(n)]] * pairs, [x[at].tobytes()] * pairs)
    (q_ids, q_sections, q_x), (ids, sections, data) = tile(0, 0), tile(1, 1000)
    batch = pa.RecordBatch.from_pydict({"ids": ids, "sections": sections, "x": data, "q_ids": q_ids, "q_sections": q_sections, "q_x": q_x})
    found = retrieval._tile_top(3, False, gated)(iter([batch]))
    tracemalloc.start()
    first = next(found).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000  # the pairs hold 26 MB
    scores = np.round(x[0] @ x[1].T, 9)
    if gated:
        scores[np.array(q_sections[0], object)[:, None] != np.array(sections[0], object)[None, :]] = -np.inf
    want = [(i, 1000 + j, scores[i, j]) for i in range(n) for j in np.lexsort((np.arange(n), -scores[i]))[:3]]
    assert [(r["query_id"], r["id"], r["score"]) for r in first] == want
    assert sum(1 for _ in found) == pairs - 1
