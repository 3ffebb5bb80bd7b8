"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton is built over normalised item words, items being kept apart by returning to the root. Documents
are streamed through it word by word; the longest match ending at each word is tracked, and a match at least
as long as the window marks its words. Runs of words whose neighbours never adjoin in any item are skipped
first, since every match there has length one at most.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, text_or_empty

WINDOW = 10
BLOCK_CHARS = 1_000_000  # item text in one automaton of 10 MB or so; more items make more automata, each with a pass of its own
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of UTF-8 text."""
    return text.translate(_WORD).split()


class _Growing:
    """The automaton while it grows, a dict of transitions for each state."""

    def __init__(self):
        self.next, self.link, self.len = [{}], [-1], [0]

    def _clone(self, p: int, q: int, w: int) -> int:
        c = len(self.len)
        self.next.append(dict(self.next[q])), self.link.append(self.link[q]), self.len.append(self.len[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def add(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, w)
        v, p = len(self.len), last
        self.next.append({}), self.link.append(0), self.len.append(self.len[last] + 1)
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = v
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[v] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, w)
        return v


class Automaton:
    """Generalised suffix automaton over items, frozen to arrays: some 12 bytes a transition, 8 a state.

    A transition is looked up as state << 32 | word among the sorted keys. window_at(state) are the items with a
    window that ends in the state; short holds items shorter than the window by the state where they end.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.words, self.names = window, {}, sorted({name for name, _ in items})
        nth = {name: i for i, name in enumerate(self.names)}
        tokens = [(nth[name], [self.words.setdefault(w, len(self.words)) for w in words_of(text)]) for name, text in items]
        grown = _Growing()
        for _, ids in tokens:
            last = 0
            for w in ids:
                last = grown.add(last, w)
        arrows = sorted((state << 32 | w, to) for state, out in enumerate(grown.next) for w, to in out.items())
        self.keys, self.to = array("q", (k for k, _ in arrows)), array("i", (t for _, t in arrows))
        self.link, self.len = array("i", grown.link), array("i", grown.len)
        del grown, arrows
        self.shortest = min((min(len(ids), window) for _, ids in tokens if ids), default=0)
        self.short: dict[int, set[tuple[int, int]]] = {}
        ends, grams = set(), set()
        for item, ids in tokens:  # where each item's windows end
            grams.update(x << 32 | y for x, y in zip(ids, ids[1:]))
            state = length = 0
            for i, w in enumerate(ids):
                state, length = self.step(state, length, w)
                if len(ids) < window and i == len(ids) - 1:
                    self.short.setdefault(self._cut(state, len(ids)), set()).add((len(ids), item))
                elif i >= window - 1:
                    ends.add(self._cut(state, window) << 32 | item)
        self.ends, self.grams = array("q", sorted(ends)), np.array(sorted(grams), np.int64)
        self.above = array("i", [-1]) * len(self.link)  # the nearest state up the links, itself included, where short items end
        if self.short:
            for v in sorted(range(1, len(self.link)), key=self.len.__getitem__):
                self.above[v] = v if v in self.short else self.above[self.link[v]] if self.link[v] >= 0 else -1

    def _cut(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.link[state] >= 0 and self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def window_at(self, state: int) -> list[int]:
        return [e & 0xFFFFFFFF for e in self.ends[bisect_left(self.ends, state << 32) : bisect_left(self.ends, (state + 1) << 32)]]

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        while True:
            key = state << 32 | w
            at = bisect_left(self.keys, key)
            if at < len(self.keys) and self.keys[at] == key:
                return self.to[at], length + 1
            if not state:
                return 0, 0
            state = self.link[state]
            length = self.len[state]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of hit words, merged and in order, and the items with occurring windows."""
        spans: list[list[int]] = []
        items: set[int] = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, set()
        get = self.words.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = ids >= 0
        if len(self.grams):
            gram = (ids[:-1] << 32) | ids[1:]
            at = np.searchsorted(self.grams, gram)
            at[at == len(self.grams)] = 0
            joined = known[:-1] & known[1:] & (self.grams[at] == gram)
        else:
            joined = np.zeros(len(ids) - 1, bool)
        # a run: words of which each adjoins the next in some item
        starts = np.flatnonzero(known & ~np.concatenate(([False], joined)))
        ends = np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
        for b, e in zip(starts.tolist(), ends.tolist()):
            if e - b < self.shortest:
                continue
            state = length = 0
            for i, w in enumerate(ids[b:e].tolist(), b):
                state, length = self.step(state, length, w)
                reach = 0
                if length >= self.window:
                    reach = length
                    items.update(self.window_at(self._cut(state, self.window)))
                if self.short:
                    v = self.above[state]
                    while v > 0:
                        for n, item in self.short[v]:
                            if n <= length:
                                items.add(item)
                                reach = max(reach, n)
                        v = self.above[self.link[v]] if self.link[v] > 0 else -1
                if reach:
                    start = i + 1 - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return spans, {self.names[i] for i in items}


def _match(shared):
    """(doc_id, text) -> doc_id, key of the text, n_words, spans of hit words, items."""

    def run(batches):
        automaton = shared.value
        for batch in batches:
            n, spans, items, key = [], [], [], []
            for text in binaries(batch.column(1)):
                words = words_of(text)
                s, found = automaton.scan(words)
                n.append(len(words)), spans.append([{"start": b, "end": e} for b, e in s]), items.append(sorted(found))
                key.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "text_key", "n_words", "spans", "items"],
            )

    return run


_MATCHES = "doc_id long, text_key binary, n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def automata(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW) -> list:
    """Broadcast automata over all items, each over BLOCK_CHARS characters of item text or about so. A task reads one of
    them; the driver holds all, some ten bytes for each character of the benchmark."""
    items = benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // BLOCK_CHARS
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = []
    for i in range(blocks):
        rows = items.where(block == i).orderBy("item_id", "text").collect()  # BLOCK_CHARS characters at most, or about so
        out.append(spark.sparkContext.broadcast(Automaton([(r[0], r[1].encode()) for r in rows], window)))
    return out


def matches(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> doc_id, text_key, n_words, spans of hit words, items.

    One row for each input row. A window is `window` consecutive words of an item, or all words of an item
    with fewer; an item without words has none. Null texts have no words. Items that share an item_id count
    once. Other columns are not read; an empty benchmark hits nothing, and empty documents give an empty result.
    """
    return _merged(documents, automata(spark, benchmark, window))


def _merged(documents: DataFrame, blocks: list) -> DataFrame:
    """Spans and items by all automata; each has its own pass over the documents."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = [docs.mapInArrow(_match(x), _MATCHES) for x in blocks]
    if len(parts) == 1:
        return parts[0]
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    return (  # as many rows for a document as there are automata, times the rows that repeat it
        found.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("rows"))
        .withColumn("spans", F.expr("""aggregate(s, cast(array() as array<struct<start: bigint, end: bigint>>), (acc, x) ->
            CASE WHEN size(acc) > 0 AND acc[size(acc) - 1].end >= x.start
                 THEN concat(slice(acc, 1, size(acc) - 1), array(struct(acc[size(acc) - 1].start AS start, greatest(acc[size(acc) - 1].end, x.end) AS end)))
                 ELSE concat(acc, array(x)) END)"""))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("rows") / len(parts)).cast("int"))))
        .select("doc_id", "text_key", "n_words", "spans", "items")
    )


def _without(text: str, hit: np.ndarray) -> str:
    """text without its hit words; of words hit one after another, what lies between them goes too."""
    where = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(_LOWER))]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    out, last = [], 0
    for b, e in edge.reshape(-1, 2).tolist():
        out.append(text[last : where[b][0]])
        last = where[e - 1][1]
    return "".join([*out, text[last:]])


def _cleaned(shared, most: float):
    """Rows of documents without the words that are hit; the rest of the columns as they are. Hits are in the last
    column, or found with the one automaton that is shared."""

    def run(batches):
        for batch in batches:
            schema = batch.schema if shared else batch.schema.remove(len(batch.schema) - 1)  # hits come last, whatever the others are called
            at, texts, keep = batch.schema.get_field_index("text"), [], []
            for i, text in enumerate(x.as_py() for x in batch.column(at)):
                words = words_of(text.encode()) if text else []
                spans = shared.value.scan(words)[0] if shared else [(s["start"], s["end"]) for s in batch.column(batch.num_columns - 1)[i].as_py() or ()]
                if spans:
                    hit = np.zeros(len(words), bool)
                    for b, e in spans:
                        hit[b:e] = True
                    if hit.mean() > most:
                        continue
                    text = _without(text, hit)
                texts.append(text), keep.append(i)
            kept = batch.select(range(len(schema))).take(pa.array(keep, pa.int64()))
            columns = [pa.array(texts, c.type) if n == "text" else c for n, c in zip(schema.names, kept.columns, strict=True)]
            if (k := schema.get_field_index("n_chars")) >= 0:
                columns[k] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def decontaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: float = 0.5) -> DataFrame:
    """documents with the hit words cut out of text, and n_chars to match; a document of which more than the
    share `most` is hit goes whole. All columns stay; null and empty texts stay as they are, as does everything
    with an empty benchmark. Rows that repeat are cut each; an empty table gives an empty result. A benchmark of
    one block takes one pass; of more, spans are found block by block and joined to the documents that have some.
    """
    blocks = automata(spark, benchmark, window)
    if len(blocks) == 1:
        return documents.mapInArrow(_cleaned(blocks[0], most), documents.schema)
    hits = _merged(documents, blocks).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"]).withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key", "spans": "hits"}).select("hit_id", "hit_key", "hits")
    # a text is known by its id and the digest by which its spans were found
    keyed = documents.select(F.struct(*documents.columns).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.unhex(F.sha2(text_or_empty(), 256)).alias("own_key"))
    met = keyed.join(hits, F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_key") == F.col("hit_key")), "left")
    return met.select(*(F.col("row")[c].alias(c) for c in documents.columns), F.col("hits").alias("\0hits")).mapInArrow(_cleaned(None, most), documents.schema)
