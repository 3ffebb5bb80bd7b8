"""Winnowing against a brute-force version, its match guarantee, and the walk over ranges against a sorted list."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm.common import table
from sparkloom.llm.winnow import _BASE, GRAM, WINDOW, fingerprints, rolled, winnowed
from sparkloom.llm.common import mixed

SCHEMA = "doc_id long, text string, key long, second long, `range` int, at int, copy boolean, fingerprint string"


def brute(text, gram=GRAM, window=WINDOW):
    codes = [ord(c) for c in text]
    if not codes:
        return []
    gram = min(gram, len(codes))
    grams = [sum(c * _BASE ** (gram - 1 - j) for j, c in enumerate(codes[i : i + gram])) % 2**64 for i in range(len(codes) - gram + 1)]
    hashes = [int(x) >> 32 for x in mixed(np.array(grams, np.uint64))]
    window, kept = min(window, len(hashes)), []
    for i in range(len(hashes) - window + 1):
        least = min(hashes[i : i + window])
        at = max(j for j in range(i, i + window) if hashes[j] == least)
        if not kept or kept[-1] != (least, at):
            kept.append((least, at))
    return kept


def expected(rows, gram=GRAM, window=WINDOW):
    """For rows of which no two share a doc_id."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = Counter()
    for at, (i, t) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        mine, other, then = brute(t, gram, window), brute(edited, gram, window), brute(after, gram, window)
        near = lambda a, b: len({x for x, _ in a} & {x for x, _ in b}) / len({x for x, _ in a + b}) if a or b else 1.0
        out[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *(" ".join(f"{h:08x}@{p}" for h, p in x) for x in (mine, other)), near(mine, other), near(mine, then)] += 1
    return out


def result(df):
    return Counter(tuple(r) for r in df.collect())


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, True, "x") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("gram", [1, 2, 3, 7, 16, 21])
def test_rolled_and_winnowed_equal_brute_force(gram):
    rng = np.random.default_rng(gram)
    for n in (0, 1, 2, 5, gram, gram + 1, 60, 300):
        for alphabet in ("ab", "abcdefghijklmnop é\U0001f600"):
            text = "".join(rng.choice(list(alphabet), n))
            for window in (1, 2, 5, 48):
                hashes, positions = winnowed(text, gram, window)
                assert list(zip(hashes.tolist(), positions.tolist())) == brute(text, gram, window)
    assert len(rolled(np.arange(50, dtype=np.uint32), gram)) == 51 - gram


def test_rightmost_of_equal_hashes():
    assert winnowed("a" * 100, 4, 10)[1].tolist() == list(range(9, 97))


def test_shared_passage_is_always_found():
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    for _ in range(200):
        passage = word(GRAM + WINDOW - 1)
        a, b = word(int(rng.integers(0, 90))) + passage + word(30), word(int(rng.integers(0, 90))) + passage + word(11)
        assert set(winnowed(a)[0].tolist()) & set(winnowed(b)[0].tolist())


@pytest.mark.parametrize("ranges", [1, 2, 7, 100])
def test_walk_over_ranges(spark, ranges):
    rng = np.random.default_rng(ranges)
    ids = rng.permutation(np.concatenate([np.arange(60), np.arange(-5, 0), rng.integers(2**40, 2**62, 40), [2**63 - 1, -(2**63)]]))
    rows = [(int(i), "".join(rng.choice(list("abc déf\n"), int(rng.integers(0, 300))))) for i in ids] + [(None, "the row without an id"), (500, None), (501, ""), (502, "x" * 200_000)]
    assert result(fingerprints(spark, documents(spark, rows).repartition(5), ranges=ranges)) == expected(rows)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_rows_that_repeat_an_id_form_one_ring(spark, ranges):
    rows = [(i // 50, f"text {i} of an id that many rows share") for i in range(300)] + [(2, "the same")] * 30 + [(None, f"none {i}") for i in range(60)]
    got = fingerprints(spark, documents(spark, rows).repartition(4), ranges=ranges).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t)) for i, t in rows)
    # every row has one next: the edits of all rows are what some order of equal ids gives, the same for any ranges
    one = fingerprints(spark, documents(spark, rows).repartition(2), ranges=1).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, one))
    assert sum(r["near_next"] == 1 for r in got if r["doc_id"] == 2) >= 29


def test_one_row_and_none(spark):
    assert result(fingerprints(spark, documents(spark, [(7, "alone with itself")]))) == expected([(7, "alone with itself")])
    assert result(fingerprints(spark, documents(spark, [(None, None)]))) == expected([(None, None)])
    assert not fingerprints(spark, documents(spark, [])).collect()


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = result(fingerprints(spark, docs, ranges=9))
    assert got == expected(rows)
    long = [r for r in got if r[1] > 1000]
    assert np.mean([r[5] for r in long]) > 0.25 and np.median([r[6] for r in long]) < 0.05
