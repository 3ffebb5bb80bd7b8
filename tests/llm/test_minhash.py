"""Near-duplicates where ids repeat, and crowds within large buckets."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import minhash
from sparkloom.llm.common import Tables
from sparkloom.llm.components import components
from tests.llm.test_training_operators import ODD, brute_components, documents, near_copies


def components_of(spark, rows, k=3, num=85):
    got = minhash.near_duplicates(spark, documents(spark, rows), k, num, 100).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got)


def test_a_repeated_id_is_one_document(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(5, a), (5, b), (3, b), (7, a), (5, ""), (7, None), (9, "apart from all of these others")]
    assert components_of(spark, rows) == brute_components(rows, 3, 85, 100)
    assert {c for d, _, c in components_of(spark, rows) if d != 9} == {3}


@pytest.mark.parametrize("small", [3, 24])
def test_repeated_ids_with_different_texts(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    rng = np.random.default_rng(small)
    rows = near_copies(seed=small, families=25) + ODD
    texts = [t for _, t in near_copies(seed=small + 1, families=9)]
    rows += [(int(rng.integers(0, 60)), t) for t in texts] + [(int(i), rows[int(j)][1]) for i, j in rng.integers(0, 50, (12, 2))] + [(4, ""), (4, None)]
    assert components_of(spark, rows) == brute_components(rows, 3, 85, 100)


def test_classes_of_one_id_in_a_large_bucket(spark, monkeypatch):
    """Many texts of one id, alike but not linked with each other, and copies of them under other ids."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):
        words = base[:]
        for at in rng.choice(120, int(rng.integers(0, 14)), replace=False):
            words[at] = f"x{i}-{at}"
        rows += [(1000 if i % 2 else i, " ".join(words)), (2000 + i, " ".join([*words[:-1], "end"]))]
    assert components_of(spark, rows) == brute_components(rows, 3, 85, 100)


def crowd(n, seed):
    """Copies of a base, and a crowd of n that share a passage of their own, far from the base, in clusters that are linked only within."""
    rng = np.random.default_rng(seed)
    base, passage = [f"b{i}" for i in range(100)], [f"p{i}" for i in range(30)]
    texts = [" ".join(base[:i] + [f"e{i}"] + base[i + 1 :]) for i in range(40)]
    for i in range(n):
        cluster = [f"c{i % (n // 4)}-{j}" for j in range(12)]
        words = base[:70] + passage + cluster
        words[int(rng.integers(0, 70))] = f"y{i}"
        texts.append(" ".join(words))
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]


@pytest.mark.parametrize("rounds", [2, 0])
def test_crowds_within_a_bucket(spark, monkeypatch, rounds):
    monkeypatch.setattr(minhash, "SMALL", 6)
    monkeypatch.setattr(minhash, "ROWS", 2)
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "CROWD", 10)
    rows = crowd(240, 1)
    got = minhash.near_duplicates(spark, documents(spark, rows), 3, 85, 100, rows=1)  # one row a band: buckets hold nearly all
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, 3, 85, 100)


def test_a_crowd_of_two_thousand_makes_no_pairs_of_all(spark):
    """One group whose leader is far from a crowd that has a passage in common: pairs in proportion to the crowd."""
    rows = crowd(2000, 2)
    tables = Tables(spark)
    texts = [t for _, t in rows]
    ids = range(len(texts))
    sets = tables.keep(spark.createDataFrame([(i, bytearray(minhash.shingles(t.encode(), 3).tobytes())) for i, t in zip(ids, texts)], "id long, shingles binary"), "sets")
    groups = tables.keep(spark.createDataFrame([(0, i) for i in ids], "leader long, id long"), "groups")
    found = components(tables, spark.createDataFrame([(0, i) for i in range(1, 40)], "a long, b long"))
    pairs, crowds = minhash._left_over(groups, found, sets, 85, 100, tables, 0)
    n, new = pairs.count(), {tuple(r) for r in crowds.collect()}
    assert n + len(new) < 20 * len(rows)
    at = defaultdict(set)
    for leader, i in new:
        at[leader].add(i)
    # every pair of a cluster is left together somewhere: in a pair or in a new group
    made = {tuple(sorted(p)) for p in pairs.collect()}
    clusters = defaultdict(list)
    for i, t in zip(ids, texts):
        clusters[t.split()[-1]].append(i)
    for members in clusters.values():
        if len(members) == 4:
            assert all((members[0], x) in made or any({members[0], x} <= g for g in at.values()) for x in members[1:])


def test_rounds_end_when_the_links_no_longer_change(spark):
    links = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("b % 50 != 0")
    got = dict(components(Tables(spark), links).collect())
    assert got == {i: i // 50 * 50 for i in range(2000) if i % 50}
