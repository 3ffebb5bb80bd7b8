"""Vectors that are made once: a store keyed by content, model and options; and semantic chunks over batches of sentences."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

Encoder = Callable[[Sequence[str]], np.ndarray]  # a batch of texts -> a row each
BATCH = 256
_STORED = "digest string, vector array<double>"


def unit_rows(encode: Encoder, texts: Sequence[str], size: int = BATCH) -> np.ndarray:
    """Unit vectors of texts, made batch by batch; a zero or non-finite one raises."""
    parts = [np.asarray(encode(texts[i : i + size]), np.float64) for i in range(0, len(texts), size)]
    if not parts:
        return np.zeros((0, 0))
    x = np.concatenate(parts)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    if len(x) != len(texts) or not np.isfinite(x).all() or (norm == 0).any():
        raise ValueError("an encoder gives one finite vector other than zero for each text")
    return x / norm


def content_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


class VectorStore:
    """Vectors of texts under `path`, for one model and its options.

    `writing-*` folders hold (digest, vector); `<n>.json` names those that count, and appears by one rename after its data.
    A writer that dies leaves a folder that nothing names. Two writers at a time both publish, one after the other; what
    both made counts once.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, load: Callable[[], Encoder], **options: object):
        key = hashlib.sha256(json.dumps([model, options], sort_keys=True).encode()).hexdigest()[:32]
        self.spark, self.path, self.load = spark, f"{path.rstrip('/')}/{key}", load

    def writings(self) -> tuple[int, list[str]]:
        found = [x for x in shared.names(self.spark, self.path) if x.endswith(".json")]
        return (int(found[-1].removesuffix(".json")), json.loads(shared.read_text(self.spark, f"{self.path}/{found[-1]}"))) if found else (0, [])

    def known(self) -> DataFrame:
        paths = [f"{self.path}/{w}" for w in self.writings()[1]]
        rows = self.spark.read.schema(_STORED).parquet(*paths) if paths else self.spark.createDataFrame([], _STORED)
        return rows.dropDuplicates(["digest"])

    def get_or_create(self, texts: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
        """(digest, vector) of all that is stored, and how many distinct texts had to be encoded now. Null texts count as
        empty, texts that repeat are encoded once; with nothing to encode, nothing is written."""
        asked = texts.select(content_digest(F.col(text)).alias("digest"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        misses = shared.kept(asked.join(self.known().select("digest"), "digest", "left_anti").dropDuplicates(["digest"]), "misses")
        n = misses.count()
        if n:
            load, writing = self.load, f"writing-{uuid.uuid4().hex}"

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                encode = load()
                for batch in batches:
                    x = unit_rows(encode, batch.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["digest", "vector"])

            misses.mapInArrow(run, _STORED).write.mode("overwrite").parquet(f"{self.path}/{writing}")
            if (there := self.spark.read.schema(_STORED).parquet(f"{self.path}/{writing}").count()) != n:
                raise RuntimeError(f"{n} vectors were to be written, and {there} are there")
            while True:
                last, names = self.writings()
                if shared.publish(self.spark, f"{self.path}/{last + 1:012d}.json", json.dumps([*names, writing])):
                    break
        return self.known(), n


def semantic_chunks(docs: DataFrame, load: Callable[[], Encoder], least: float = 0.65, size: int = 800, prefix: str = "") -> DataFrame:
    """docs(id, text) -> id, at, text: neighbouring sentences of a text stay together while their vectors' cosine is `least` or
    more and the chunk, joined by blanks, is no longer than `size`.

    Sentences of a partition are encoded in batches and met in order where their texts lie, one at a time: neither a long
    document nor its vectors are held, and no sentence or vector is shuffled. Sentences end at . ! ? and blanks, or at line
    ends. Null and blank texts have no chunks; rows that repeat an id are cut each; an empty table gives an empty result.
    """
    if not 0 <= least <= 1 or size <= 0:
        raise ValueError("the threshold lies between 0 and 1, and the size is positive")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")  # before a text becomes many rows
    cut = numbered.select("row", "id", F.explode(F.split("text", r"(?U)(?<=[.!?])\s+|\n+")).alias("unit"))
    units = cut.withColumn("unit", F.btrim("unit", F.lit(_BLANKS)))
    kind = dict(docs.dtypes)["id"]
    return units.mapInArrow(_in_order(load, least, size, prefix), f"id {kind}, at int, text string")


# Fixed value: the characters that (?U)\s matches in Java.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _in_order(load: Callable[[], Encoder], least: float, size: int, prefix: str):
    """Sentences of a text follow each other, and lie in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        row, id_, at, chunk, before = None, None, 0, "", None
        for batch in batches:
            out, kind = [], batch.column("id").type
            rows, ids, units = (batch.column(n).to_pylist() for n in ("row", "id", "unit"))
            met = [x for x in zip(rows, ids, units) if x[2]]
            for start in range(0, len(met), BATCH):
                some = met[start : start + BATCH]
                for (r, i, unit), v in zip(some, unit_rows(encode, [prefix + x[2] for x in some])):
                    if r == row and len(chunk) + 1 + len(unit) <= size and float(before @ v) >= least:
                        chunk += " " + unit
                    else:
                        if row is not None:
                            out.append((id_, at, chunk))
                        at = at + 1 if r == row else 0
                        row, id_, chunk = r, i, unit
                    before = v
            yield _chunk_rows(out, kind)
        if row is not None:
            yield _chunk_rows([(id_, at, chunk)], kind)

    return run


def _chunk_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int32(), pa.string()))], ["id", "at", "text"])


def hashing_encoder(size: int = 64) -> Encoder:
    """Counts of words by a hash of each; a text without words has one of its own. It needs no model and no training."""
    word, place = re.compile(r"\w+"), _Places(size).__getitem__

    def encode(texts: Sequence[str]) -> np.ndarray:
        places: list[int] = []
        ends = [0]
        for t in texts:
            places.extend(map(place, word.findall(t.lower()) or [""]))
            ends.append(len(places))
        cells = np.repeat(np.arange(len(texts)) * size, np.diff(ends)) + np.array(places, np.int64)
        return np.bincount(cells, minlength=len(texts) * size).reshape(len(texts), size).astype(np.float64)

    return encode


class _Places(dict):
    """Places of words by hash, made once for each of the words met lately."""

    def __init__(self, size: int, most: int = 100_000):
        super().__init__()
        self.size, self.most = size, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        at = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little") % self.size
        return at
