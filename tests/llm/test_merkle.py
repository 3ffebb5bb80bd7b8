"""The Merkle manifest against a brute-force tree, and ranks from digit histograms against sorting."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import merkle
from sparkloom.llm.common import table
from sparkloom.llm.merkle import manifest
from sparkloom.llm.ranks import digits, ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, rank int, node string, n long, path string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))


def levels(nodes):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        found.append(nodes)
    return found


def steps(found, i):
    for nodes in found[:-1]:
        first = i // 16 * 16
        yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 16])
        i //= 16


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> Counter of result rows."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = Counter()
    for at, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = [*steps(trees[s], i), *steps(top, at)]
            folded = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                folded = leaf(*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
            for left, right in path:
                folded = sha(left + folded + right)
            out[r[0], own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), folded, folded == top[-1][0]] += 1
    return out


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def documents(spark, rows):
    return spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "g", 3, "x", 9, "p") for r in rows], SCHEMA)


def made(seed, sizes):
    rng = np.random.default_rng(seed)
    ids = rng.permutation(sum(sizes) * 3)
    return [(int(ids[i]), s, "en", 3, f"Text {i}") for i, s in enumerate([None if k == 0 else f"s{k}" for k, n in enumerate(sizes) for _ in range(n)])]


@pytest.mark.parametrize("sizes", [(1,), (2,), (16,), (17,), (1, 1), (256, 257, 1, 3), (16, 300, 15, 4100)])
def test_trees_of_all_shapes(spark, sizes):
    rows = made(7, sizes)
    assert result(manifest(spark, documents(spark, rows))) == brute(rows)


def test_nulls_ties_repeats_many_sources_and_long_texts(spark):
    rows = [
        (None, "a", None, None, None), (None, "a", None, None, None), (None, None, "en", 1, "Q"), (5, None, "en", 0, ""), (5, None, "en", 0, ""), (5, "a", "en", 2, "Ab"), (5, "a", "en", 2, "Aa"),
        (-3, "a", "de", -7, "ÜBER Ab"), (-(2**63), "a", "x", 1, "L" * 300_000), (2**63 - 1, "a", "x", 1, "l"), (12, "", "", None, "A"), (12, "é", "en", 1, "B"), (12, "z", "en", 1, "C"), (12, "\U0001f600", "en", 1, "D"), (12, "￮", "en", 1, "E"),
    ]
    rows += [(40, "hot", "en", 4, "Same")] * 700 + [(i % 3 + 100, "hot", "en", 4, f"Other {i}") for i in range(400)]
    rows += [(i, f"site{i % 333}", "en", 1, "T") for i in range(600)]
    assert result(manifest(spark, documents(spark, rows))) == brute(rows)


def test_crowded_id_goes_by_leaf_digits(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CROWD", 100)
    rows = [(None if i % 2 else 8, "a", "en", i, f"T{i}") for i in range(900)]
    assert result(manifest(spark, documents(spark, rows))) == brute(rows)


def test_many_copies_are_made_in_parts(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART", 64)
    rows = [(3, "a", "en", 1, "Same")] * 1000 + [(2, "a", "en", 1, "x"), (4, "a", "en", 1, "y")]
    assert result(manifest(spark, documents(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert result(manifest(spark, documents(spark, []))) == Counter()


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = result(manifest(spark, docs))
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_ranks_equal_sorting(spark):
    rng = np.random.default_rng(1)
    keys = sorted({(int(g), int(k)) for g, k in zip(rng.integers(0, 3, 3000), rng.integers(-(2**40), 2**40, 3000))})
    df = spark.createDataFrame([(g, k, int(k % 3 + 1)) for g, k in keys], "g int, k long, n long")
    prefixes = digits(F.col("k"), min(k for _, k in keys), max(k for _, k in keys), "k")
    got = {(r["g"], r["k"]): r["before"] for r in ranked(df.withColumns(prefixes), ["g"], [*prefixes, "k"]).collect()}
    sums = defaultdict(int)
    for g, k in keys:
        assert got[g, k] == sums[g]
        sums[g] += k % 3 + 1
