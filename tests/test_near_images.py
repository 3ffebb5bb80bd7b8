"""Near-duplicate images against one walk over each document."""

from collections import Counter

import numpy as np
import pytest

from sparkloom.operators import near_images as ni
from sparkloom.plans import live

SCHEMA = "doc string, position int, image_id string, visual_hash string, width int, height int, c string, slot int"


def brute(rows, bits=6, aspect=0.01):
    out, docs = Counter(), {}
    for r in rows:
        if None in (r[0], r[3]):
            out[r[0], r[2], r[2]] += 1
        else:
            docs.setdefault(r[0], []).append(r)
    for doc, found in docs.items():
        kept, slot = [], []
        for _, _, name, h, width, height in sorted(found, key=lambda r: (r[1], r[2])):
            mine = (int(h, 16), width / max(height, 1), width * height, name)
            at = next((i for i, k in enumerate(kept) if abs(mine[1] - k[1]) <= aspect and (mine[0] ^ k[0]).bit_count() <= bits), None)
            if at is None:
                at = len(kept)
                kept.append(mine)
            elif mine[2] > kept[at][2]:
                kept[at] = mine
            slot.append((name, at))
        for name, at in slot:
            out[doc, name, kept[at][3]] += 1
    return out


def made(seed, families, copies, most=9, blank=0):
    """Families of hashes that drift apart bit by bit; the first `blank` digits are the same in all."""
    rng = np.random.default_rng(seed)
    rows = []
    for doc in ("a", "b"):
        for f in range(families):
            h = int.from_bytes(rng.bytes(32), "big") >> (4 * blank)
            for _ in range(copies):
                for bit in rng.integers(0, 256 - 4 * blank, int(rng.integers(0, most))):
                    h ^= 1 << int(bit)
                rows.append((doc, int(rng.integers(0, 50)), f"i{len(rows)}", f"{h:064x}", int(rng.choice([100, 200, 101, 300])), int(rng.choice([100, 200]))))
    return rows


def result(spark, rows):
    return Counter(tuple(r) for r in ni.near_images(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect())


@pytest.mark.parametrize(("hot", "blank"), [(64, 0), (2, 30), (0, 0)])
def test_groups_are_those_of_one_walk(spark, monkeypatch, hot, blank):
    monkeypatch.setattr(ni, "HOT", hot)
    rows = made(hot + blank, 9, 12, blank=blank)
    rows += [("a", 1, "same", rows[0][3], 100, 100)] * 3 + [(None, 1, "lost", rows[0][3], 1, 1), ("a", 2, "bare", None, 5, 5), ("b", 3, "flat", rows[0][3], 5, 0)]
    got = result(spark, rows)
    assert got == brute(rows)
    assert any(i != k for _, i, k in got)


def test_all_links_are_found(spark, monkeypatch):
    monkeypatch.setattr(ni, "HOT", 3)
    hashes = sorted({r[3] for r in made(4, 6, 25, 4, blank=20)})
    df = spark.createDataFrame([("d", h) for h in hashes], "doc string, h string")
    want = {(a, b) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if (int(a, 16) ^ int(b, 16)).bit_count() <= 6}
    assert {(r["a"], r["b"]) for r in ni.linked_hashes(df, 6).collect()} == want and len(want) > 100


def test_many_equal_images_and_none(spark):
    rows = [("d", i, f"i{i:04d}", "f" * 64, 10 + i % 3, 10) for i in range(2000)]
    assert result(spark, rows) == brute(rows)
    assert not result(spark, [])


def test_images_of_embeddings(spark, sf_dir):
    rows = [tuple(r) for r in live._images(spark, sf_dir).select("doc", "position", "image_id", "visual_hash", "width", "height").collect()]
    got = Counter(tuple(r) for r in live.near_image_groups(spark, sf_dir).collect())
    assert got == brute(rows) and sum(got.values()) == len(rows)
    assert 0 < sum(i != k for _, i, k in got) < len(rows)
