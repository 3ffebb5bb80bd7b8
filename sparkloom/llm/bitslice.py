"""Ranked lexical search over a bit-sliced impact index.

Documents are indexed in blocks: for each term the documents that hold it and how often. Once counts over the whole
corpus are known, a term's impacts in a block become bitmaps, one for each bit of an impact. An item's scores are
added up on these bitmaps by carry arithmetic, whole blocks at a time, and the best k are found by descending
from the most significant slice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, binaries, text_or_empty

BLOCK = 16_384  # documents of a block of the search
POSTINGS = 2_000_000  # postings of a block of the index
VOCABULARY = 1_000_000  # terms of items that are sent to tasks; with more, all terms are indexed
ENTRIES = 500_000  # terms of items, repeats within an item aside, that are searched in one pass over the index
_PIECE = 4_000_000  # bytes of a text that are cut into terms at a time
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_INDEX = "docs array<bigint>, lengths array<bigint>, terms array<string>, ends array<int>, at array<int>, tf array<int>"
_FOUND = "item bigint, item_id bigint, doc_id bigint, score bigint"
_U1 = np.uint64(1)


def terms(text: Column) -> Column:
    """The terms of a text, in order: runs of ASCII letters and digits and of all beyond ASCII, with small ASCII letters."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), lambda t: t != "")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    text, at = text.translate(_TERMS), 0
    while at < len(text):
        end = len(text) if at + _PIECE >= len(text) else text.find(b" ", at + _PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class _Block:
    """Postings of some documents, term by term."""

    def __init__(self) -> None:
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.ids: dict[bytes, int] = {}
        self.tid: list[int] = []
        self.at: list[int] = []
        self.tf: list[int] = []

    def add(self, doc_id: int | None, text: bytes, wanted: frozenset[bytes] | None) -> None:
        n, counts = 0, Counter()
        for words in _pieces(text):
            n += len(words)
            counts.update(words if wanted is None else filter(wanted.__contains__, words))
        if not n:
            return
        for term, tf in counts.items():
            self.tid.append(self.ids.setdefault(term, len(self.ids)))
            self.at.append(len(self.docs))
            self.tf.append(tf)
        self.docs.append(doc_id)
        self.lengths.append(n)

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        tid = np.array(self.tid, np.int32)
        order = np.argsort(tid, kind="stable")
        ends = np.cumsum(np.bincount(tid, minlength=len(self.ids))).astype(np.int32)
        values = (self.docs, self.lengths, [t.decode() for t in self.ids], ends, np.array(self.at, np.int32)[order], np.array(self.tf, np.int32)[order])
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def index(documents: DataFrame, wanted: DataFrame | None = None, bound: int = VOCABULARY) -> DataFrame:
    """documents(doc_id, text) -> blocks(docs, lengths, terms, ends, at, tf), of documents with terms only.

    Term i of a block is in its documents at[ends[i - 1]:ends[i]], tf times each. With `wanted`, a column of terms of
    which there are no more than `bound`, postings of other terms are left out; lengths count all terms.
    """
    some = wanted.limit(bound + 1).toArrow().column(0).to_pylist() if wanted is not None else None
    keep = documents.sparkSession.sparkContext.broadcast(None if some is None or len(some) > bound else frozenset(t.encode() for t in some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
        schema = pa.schema([(x.split()[0], pa.list_(of[x.split("<")[1][:-1]])) for x in _INDEX.split(", ")])
        block = _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), binaries(batch.column(1))):
                block.add(doc_id, text, keep.value)
                if len(block.docs) >= BLOCK or len(block.at) >= POSTINGS:
                    yield block.row(schema)
                    block = _Block()
        if block.docs:
            yield block.row(schema)

    return documents.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, _INDEX)


def sliced(at: np.ndarray, impacts: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (bits, words) of the impacts' bits; at: ascending places of the documents that have them."""
    bits = int(impacts.max()).bit_length()
    has = (impacts[None, :] >> np.arange(bits)[:, None]) & 1
    ones = np.where(has == 1, _U1 << (at & 63).astype(np.uint64), np.uint64(0))
    word = at >> 6
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros((bits, words), np.uint64)
    out[:, word[starts]] = np.bitwise_or.reduceat(ones, starts, axis=1)
    return out


def added(parts: list[tuple[np.ndarray, int]], words: int, bits: int) -> np.ndarray:
    """The sum of bitmaps, each taken `times` over, as bitmaps: three numbers to two without waiting for carries,
    and the carries of the last two rippled through."""
    total, carry = np.zeros((bits, words), np.uint64), np.zeros((bits, words), np.uint64)
    for part, times in parts:
        for shift in range(times.bit_length()):
            if times >> shift & 1:
                x = np.zeros_like(total)
                x[shift : shift + len(part)] = part
                either = total ^ carry
                majority = (total & carry) | (either & x)
                total = either ^ x
                carry[1:] = majority[:-1]
                carry[0] = 0
    over = np.zeros(words, np.uint64)
    for b in range(bits):
        either = total[b] ^ carry[b]
        over, total[b] = (total[b] & carry[b]) | (either & over), either ^ over
    return total


def descended(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the documents that are surely among the k with the largest sums over 0, and of those tied for the rest."""
    sure, open_ = np.zeros(sums.shape[1], np.uint64), np.bitwise_or.reduce(sums, axis=0)
    for row in sums[::-1]:
        above = open_ & row
        n = int(np.bitwise_count(sure | above).sum())
        if n > k:
            open_ = above
        else:
            sure, open_ = sure | above, open_ & ~row
            if n == k:
                return sure, np.zeros_like(sure)
    return sure, open_


def places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.astype("<u8").view(np.uint8), bitorder="little"))


def values(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    bits = (sums[:, at >> 6] >> (at & 63).astype(np.uint64)) & _U1
    return (bits.astype(np.int64) << np.arange(len(sums))[:, None]).sum(axis=0)


class _Search:
    """Items against blocks, one after the other; the k best of each item so far."""

    def __init__(self, items: list[tuple], n: int, length: int, k: int):
        self.items, self.n, self.length, self.k = items, n, length, k
        self.best: list[list[tuple]] = [[] for _ in items]  # (-score, no id, doc_id), ascending
        self.wanted = {t for _, _, entries in items for t, _, _ in entries}

    def block(self, rows: list[dict]) -> None:
        """rows: blocks of the index that are searched as one."""
        docs = [d for r in rows for d in r["docs"]]
        lengths = np.concatenate([r["lengths"] for r in rows])
        if 75 * self.n * int(lengths.max()) < 2**63:
            m = 25 + 75 * lengths * self.n // self.length
        else:
            m = np.array([25 + 75 * x * self.n // self.length for x in lengths.tolist()], np.int64)
        held: dict[str, list[tuple]] = {}
        first = 0
        for r in rows:
            begin = 0
            for term, end in zip(r["terms"], r["ends"].tolist()):
                if term in self.wanted:
                    held.setdefault(term, []).append((r["at"][begin:end].astype(np.int64) + first, r["tf"][begin:end].astype(np.int64)))
                begin = end
            first += len(r["docs"])
        shares = {}
        for term, found in held.items():
            at, tf = (np.concatenate(x) for x in zip(*found))
            shares[term] = at, 1_000_000_000 * tf // (1000 * tf + 8 * m[at])
        words, slices = -(-len(docs) // 64), {}
        for i, (_, _, entries) in enumerate(self.items):
            here = [(t, times, w) for t, times, w in entries if w and t in shares]  # a term of nearly all documents may weigh nothing
            most = sum(times * w * int(shares[t][1].max()) for t, times, w in here)
            if not most or len(self.best[i]) == self.k and most < -self.best[i][-1][0]:
                continue  # no document here can come in
            for t, _, w in here:
                if t not in slices:
                    slices[t] = sliced(shares[t][0], w * shares[t][1], words)
            self._keep(i, added([(slices[t], times) for t, times, _ in here], words, most.bit_length()), docs)

    def _keep(self, i: int, sums: np.ndarray, docs: list[int | None]) -> None:
        sure, tied = map(places, descended(sums, self.k))
        keyed = lambda at: [(-s, docs[p] is None, docs[p] or 0) for s, p in zip(values(sums, at).tolist(), at.tolist())]
        self.best[i] = sorted([*self.best[i], *keyed(sure), *sorted(keyed(tied))[: self.k - len(sure)]])[: self.k]


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, rows, size = _Search(*shared.value, k), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values for name in batch.schema.names}
                rows.append({n: v.to_pylist() if n in ("docs", "terms") else v.to_numpy(zero_copy_only=False) for n, v in row.items()})
                size += len(rows[-1]["docs"])
                if size >= BLOCK:
                    search.block(rows)
                    rows, size = [], 0
        if rows:
            search.block(rows)
        found = [(item, item_id, None if none else doc, -s) for (item, item_id, _), best in zip(search.items, search.best) for s, none, doc in best]
        names = [x.split()[0] for x in _FOUND.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 4)], names)

    return run


def search(spark: SparkSession, documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """documents(doc_id, text), items(item_id, text) -> item_id, rank, doc_id, score: the k best documents of each item.

    Scores are whole numbers as the contract has them, and exact; only documents with a score over 0 are ranked, equal
    scores by doc_id with a null last. Null, empty and term-less texts are in no result. Documents that repeat are
    ranked each, and so is every row of items. Empty tables give an empty result. Other columns are not read.

    The index is made in one pass over the documents. Items are searched in sets of bounded size, each in one pass over
    the index; a task keeps the k best of each item, so what is shuffled is k rows an item and task.
    """
    tables = Tables(spark)
    texts = tables.keep(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")), "items")
    entries = tables.keep(texts.select("item", F.explode(terms(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times")), "entries")
    blocks = tables.keep(index(documents, entries.select("term").distinct()), "index")
    n, length = blocks.agg(F.sum(F.size("docs")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    if not n:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    each = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.get("ends", i) - F.coalesce(F.get("ends", i - 1), F.lit(0))).alias("df")))
    dfs = blocks.select(F.explode(each).alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.sum("x.df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).alias("w")
    weighted = entries.join(dfs, "term").select("item", F.struct("term", "times", weight).alias("entry"))
    rows = tables.keep(weighted.groupBy("item").agg(F.collect_list("entry").alias("entries")).join(texts.select("item", "item_id"), "item"), "weights")
    sets = -(-(rows.agg(F.sum(F.size("entries"))).first()[0] or 0) // ENTRIES)
    found = spark.createDataFrame([], _FOUND)
    for i in range(sets):
        some = rows.where(F.pmod(F.xxhash64("item"), F.lit(sets)) == i).collect()
        shared = spark.sparkContext.broadcast(([(r["item"], r["item_id"], [tuple(e) for e in r["entries"]]) for r in some], n, length))
        tasks = max(min(spark.sparkContext.defaultParallelism, -(-n // 1024)), -(-n // (4 * BLOCK)))  # so that small blocks are searched together
        found = found.unionByName(blocks.coalesce(tasks).mapInArrow(_search(shared, k), _FOUND))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
