"""The bit-sliced index against sums in plain Python, and ranked search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import bitslice
from sparkloom.llm.bitslice import added, descended, places, search, sliced, values
from sparkloom.llm.common import table

SCHEMA = "doc_id long, item_id long, text string, item long, term string, score long, docs string"


def cut(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def brute(docs, items, k=10):
    held = [(i, Counter(w), len(w)) for i, w in ((i, cut(t)) for i, t in docs) if w]
    n, length, df = len(held), sum(x[2] for x in held), Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for i, c, size in held:
            m = 25 + 75 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in cut(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(found)[:k], 1):
            out[item, rank, None if none else i, -s] += 1
    return out


def result(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def rows(spark, found):
    return spark.createDataFrame([(i, i, t, 1, "t", 2, "d") for i, t in found], SCHEMA)


def made(seed, n, words=9):
    rng = np.random.default_rng(seed)
    vocab = np.array([f"w{i}" for i in range(60)] + ["Übung", "été", "A1", "x_y", "日本"])
    weight = 1 / np.arange(1, len(vocab) + 1)
    return [(int(i), " ".join(rng.choice(vocab, int(rng.integers(0, words)), p=weight / weight.sum()))) for i in rng.permutation(n)]


def test_slices_add_up_and_the_best_are_found():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 400))
        words, sums, parts, bound = -(-n // 64), np.zeros(n, np.int64), [], 0
        for _ in range(int(rng.integers(1, 9))):
            at = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
            impacts, times = rng.integers(1, int(rng.integers(2, 2**36)), len(at)), int(rng.integers(1, 8))
            sums[at] += impacts * times
            bound += int(impacts.max()) * times
            parts.append((sliced(at, impacts, words), times))
        total = added(parts, words, bound.bit_length())
        assert values(total, np.arange(n)).tolist() == sums.tolist()
        for k in (1, 3, 10, 500):
            sure, tied = map(places, descended(total, k))
            order = sorted((-s, i) for i, s in enumerate(sums.tolist()) if s)
            if len(order) <= k:
                assert sorted([*sure, *tied]) == sorted(i for _, i in order)
            else:
                least = -order[k - 1][0]
                assert len(sure) <= k <= len(sure) + len(tied) and (values(total, tied) == least).all()
                assert set(sure) | set(tied) >= {i for _, i in order[:k]} and (values(total, sure) >= least).all()


@pytest.mark.parametrize("parts", [1, 6])
def test_search_equals_brute_force(spark, parts):
    docs = made(1, 300) + [(None, "w1 w2 nulls"), (301, None), (302, ""), (303, " .,"), (7, "w1 w2"), (7, "w1 w2"), (304, "w3 " * 50_000), (-4, "W3-été"), (305, "same")] + [(400 + i, "tie tie") for i in range(30)]
    items = made(2, 30, 30) + [(99, "tie"), (99, "tie"), (None, "w0 w0 w0 W5"), (100, None), (101, "absent"), (102, "nulls. W1"), (103, "")]
    assert result(search(spark, rows(spark, docs).repartition(parts), rows(spark, items))) == brute(docs, items)


def test_search_in_sets_without_vocabulary_and_in_small_blocks(spark, monkeypatch):
    docs, items = made(3, 400), made(4, 25, 40)
    want = brute(docs, items)
    monkeypatch.setattr(bitslice, "ENTRIES", 30)
    assert result(search(spark, rows(spark, docs), rows(spark, items))) == want
    whole = bitslice.index(rows(spark, docs), rows(spark, items).select("text"), bound=0)  # more terms than the bound: all are indexed
    assert {t for r in whole.select("terms").collect() for t in r[0]} == {w for _, t in docs for w in cut(t)}
    monkeypatch.setattr(bitslice, "VOCABULARY", 3)
    monkeypatch.setattr(bitslice.index, "__defaults__", (None, 3))
    assert result(search(spark, rows(spark, docs), rows(spark, items))) == want


def test_terms_of_a_long_text_are_cut_in_pieces(monkeypatch):
    text = " ".join(f"T{i % 97}" for i in range(5000)).encode()
    want = text.lower().split()
    monkeypatch.setattr(bitslice, "_PIECE", 50)
    assert [w for p in bitslice._pieces(text) for w in p] == want


def test_empty_tables(spark):
    assert not result(search(spark, rows(spark, []), rows(spark, [(1, "a")])))
    assert not result(search(spark, rows(spark, [(1, "a")]), rows(spark, [])))


def test_whole_tables(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert result(search(spark, docs, items)) == want
