"""A store of vectors over two runs, dead and rival writers, and semantic chunks against the split of one text."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import text, vectors
from sparkloom.operators.vectors import VectorStore, hashing_encoder, semantic_chunks, unit_rows
from sparkloom.plans import live
from sparkloom.sources import shared


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, digest string")


def test_only_changed_texts_are_encoded(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path), "m", hashing_encoder, size=64)
    rows = [(i, f"text {i % 40} of it") for i in range(100)] + [(200, None), (201, "")]
    known, n = store.get_or_create(frame(spark, rows))
    assert n == 41 and known.count() == 41
    changed = [(i, t if i != 7 else "text 7, but other") for i, t in rows] + [(300, "new")]
    known, n = store.get_or_create(frame(spark, changed))
    assert n == 2 and known.count() == 43
    assert store.get_or_create(frame(spark, changed))[1] == 0 and len(store.writings()[1]) == 2
    got = {r["digest"]: r["vector"] for r in known.collect()}
    import hashlib

    for _, t in changed:
        want = unit_rows(hashing_encoder(), [t or ""])[0]
        assert got[hashlib.sha256((t or "").encode()).hexdigest()] == pytest.approx(want.tolist())
    # another model, or other options, is another store
    assert VectorStore(spark, str(tmp_path), "m", hashing_encoder, size=32).get_or_create(frame(spark, rows[:3]))[1] == 3


def test_dead_and_rival_writers(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path), "m", hashing_encoder)
    store.get_or_create(frame(spark, [(1, "one")]))
    store.known().write.parquet(f"{store.path}/writing-of-one-that-died")
    assert store.known().count() == 1 and store.get_or_create(frame(spark, [(1, "one"), (2, "two")]))[1] == 1
    last, names = store.writings()
    store.known().write.parquet(f"{store.path}/writing-rival")
    assert shared.publish(spark, f"{store.path}/{last + 1:012d}.json", __import__("json").dumps([*names, "writing-rival"]))
    assert store.known().count() == 2  # what both made counts once
    assert store.get_or_create(frame(spark, [(3, "three")]))[1] == 1 and len(store.writings()[1]) == len(names) + 2


def test_broken_encoders_publish_nothing(spark, tmp_path):
    def zeros():
        import numpy

        return lambda texts: numpy.zeros((len(texts), 4))

    store = VectorStore(spark, str(tmp_path), "z", zeros)
    with pytest.raises(Exception, match="other than zero"):
        store.get_or_create(frame(spark, [(1, "one")]))
    assert store.writings() == (0, []) and not store.known().collect()
    assert store.get_or_create(frame(spark, []))[1] == 0


def brute(rows, least, size):
    out = Counter()
    for i, t in rows:
        units = [u.strip() for u in re.split(r"(?<=[.!?])\s+|\n+", (t or "").strip()) if u.strip()]
        if units:
            for at, c in enumerate(text.semantic_split(units, unit_rows(hashing_encoder(), units), least, size)):
                out[i, at, c] += 1
    return out


@pytest.mark.parametrize(("least", "size"), [(0.3, 60), (0.0, 40), (1.0, 800), (0.65, 800)])
def test_semantic_chunks_are_those_of_one_text(spark, monkeypatch, least, size):
    monkeypatch.setattr(vectors, "BATCH", 7)
    rng = np.random.default_rng(int(least * 100))
    words = ["a", "b", "cc", "été", "word"]
    some = lambda: " ".join(rng.choice(words, int(rng.integers(1, 6)))) + str(rng.choice([". ", "! ", "?\n", "\n\n", " ... ", "."]))
    rows = [(i, "".join(some() for _ in range(int(rng.integers(0, 20))))) for i in range(60)] + [(100, None), (101, " \n "), (3, "Again. Again."), (3, "Again. Again."), (102, "x" * 900 + ". y"), (None, "no id. none")]
    got = Counter(tuple(r) for r in semantic_chunks(frame(spark, rows), hashing_encoder, least, size).collect())
    assert got == brute(rows, least, size)


def test_semantic_chunks_of_a_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in live.chunk_semantic(spark, sf_dir).collect()) == brute(rows, 0.3, 400)
    with pytest.raises(ValueError):
        semantic_chunks(frame(spark, []), hashing_encoder, 2.0)


def test_sentences_are_met_where_their_texts_lie(spark):
    made = semantic_chunks(frame(spark, [(1, "One. Two."), (2, None)]), hashing_encoder)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and plan.count("MapInArrow") == 1
    assert Counter(tuple(r) for r in made.collect()) == {(1, 0, "One."): 1, (1, 1, "Two."): 1}


def test_ends_of_sentences_are_the_blanks_of_the_pattern(spark):
    rows = spark.createDataFrame([(c, f"{chr(c)}x{chr(c)}") for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000], "id long, t string")
    other = rows.where(F.regexp_replace("t", r"(?U)^\s+|\s+$", "") != F.btrim("t", F.lit(vectors._BLANKS)))
    assert not other.collect() and rows.where(F.btrim("t", F.lit(vectors._BLANKS)) == "x").count() == len(vectors._BLANKS)


def test_words_are_hashed_once(monkeypatch):
    hashed, plain = [], vectors.hashlib.blake2b
    monkeypatch.setattr(vectors.hashlib, "blake2b", lambda data, **options: hashed.append(data) or plain(data, **options))
    encode, texts = hashing_encoder(8), ["b a B", "", "a é a"] * 5
    got = encode(texts)
    want = np.zeros((15, 8))
    for i, t in enumerate(texts):
        for w in t.lower().split() or [""]:
            want[i, int.from_bytes(plain(w.encode(), digest_size=4).digest(), "little") % 8] += 1
    assert (got == want).all() and got.dtype == np.float64 and sorted(hashed) == [b"", b"a", b"b", "é".encode()]
    assert encode([]).shape == (0, 8)
    few = vectors._Places(8, 2)  # no more words than that are held
    assert [few[w] for w in "abcabc"] == [few[w] for w in "abc"] * 2 and len(few) <= 2
