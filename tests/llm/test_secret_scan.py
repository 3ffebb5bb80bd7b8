"""Secret scans over texts of a megabyte: no recursion in the allow-list, positions and windows in linear time."""

import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm.secret_scan import ALLOWED, BASE, CLASSES, joined, secret_spans

SECONDS = 40  # each takes some seconds; a square of matches, or of a candidate, takes many minutes


def spans(spark, text, **more):
    began = time.time()
    got = secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), **more).collect()[0]["spans"]
    assert time.time() - began < SECONDS
    return [(s["kind"], s["start"], s["end"]) for s in got]


@pytest.mark.parametrize("text", ["a/" * 500_000 + "a", "word-or_other/" * 70_000 + "end", "abcdefghijklmnopqrstuvwxyz" * 40_000, "0123456789" * 100_000, "0123456789abcdef" * 60_000, "0123456789abcdefghijklmnopqrstuvwxyz" * 30_000])
def test_long_allowed_candidates(spark, text):
    assert not [s for s in spans(spark, text) if s[0].endswith("_entropy")]


def test_allowed_runs_match_whatever_their_order():
    runs = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]
    rng = np.random.default_rng(3)
    for _ in range(2000):
        text = "".join(rng.choice(runs, int(rng.integers(1, 7))))
        assert re.fullmatch(ALLOWED[2], text), text
        assert not re.fullmatch(ALLOWED[2], text[:-1] + "!")


def test_many_matches(spark):
    rng = np.random.default_rng(4)
    found = ["".join(rng.choice(list("0123456789abcdef"), 30)) for _ in range(50_000)]
    text = "é ".join(found)
    got = spans(spark, text, classes=())
    assert got == [("hex", i * 32, i * 32 + 30) for i in range(50_000)]
    mixed = " ".join(f"token: {x[:9]} AKIA{x[:17].upper()}" for x in found[:20_000])
    want = [("assign", m.start(), m.end()) for m in re.finditer(r"token: [0-9a-f]{9}", mixed)] + [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]{16,}", mixed)]
    assert spans(spark, mixed, classes=()) == sorted(want, key=lambda s: s[1])


def test_many_candidates_with_both_classes(spark):
    rng = np.random.default_rng(5)
    text = " ".join("".join(rng.choice(list("0123456789abcdef"), 30)) for _ in range(20_000))
    got = Counter(k for k, *_ in spans(spark, text))
    assert got["hex"] == 20_000 and got["hex_entropy"] > 15_000


def test_one_candidate_of_a_megabyte(spark):
    kind, alphabet, _, window, bits = CLASSES[1]
    rng = np.random.default_rng(6)
    text = "A" * 1000 + "".join(rng.choice(list(alphabet), 1_000_000)) + "A" * 1000
    hot = []
    for at in [*range(900, 1200), *range(1_000_700, 1_001_300)]:
        counts = Counter(text[at : at + window]).values()
        if -sum(c / window * math.log2(c / window) for c in counts) >= bits:
            hot.append(at)
    assert [s for s in spans(spark, text) if s[0] == kind] == [(kind, hot[0], hot[-1] + window)]


def test_windows_too_wide_for_packed_counts_are_refused(spark):
    with pytest.raises(ValueError, match="fewer than 32"):
        spans(spark, "x", classes=(("wide", "abc", "[abc]{32,}", 32, 1.0),))


def test_empty_lists(spark):
    assert spans(spark, "nothing here", classes=(), allowed=()) == []
    assert joined(F.lit(None)) is not None and len(BASE) == 3
