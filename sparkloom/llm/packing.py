"""Best-fit packing by patterns: non-negative least squares over few-document length patterns.

The histogram of piece lengths (a row for each length, so bounded by the sequence length) is all that the
driver sees. Repeat counts of patterns are fitted to it, rounded down and carried out; what they leave is
packed by best fit on the histogram. The plan gives ranges of ranks within a length to places in sequences,
so every piece finds its place by a join on its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, text_or_empty
from .tokens import WordIds, loaded

SIZE = 2048
BINS = 64  # length classes of the patterns
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, at long"


def _cut(path: str, size: int, end: int):
    """(doc_id, text) -> pieces of a document's ids; at: the piece's number among those of its length in its task."""

    def run(batches):
        tokenizer, task = loaded(WordIds, path), TaskContext.get().partitionId()
        stop, counts = np.array([end], "<u4").tobytes(), defaultdict(int)
        for batch in batches:
            rows = []
            texts = batch.column(1).to_pylist()
            for doc, raw in zip(batch.column(0).to_pylist(), tokenizer.ids(texts), strict=True):
                raw += stop
                for k, b in enumerate(range(0, len(raw), size * 4)):
                    part = raw[b : b + size * 4]
                    n = len(part) // 4
                    rows.append((doc, k, b // 4, n, zlib.crc32(part), task, counts[n]))
                    counts[n] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "at"])

    return run


def patterns(size: int, bins: int) -> list[tuple[int, ...]]:
    """Multisets of up to four length classes that fill a sequence; class i holds lengths up to (i + 1) * size / bins."""
    out = []
    for a in range(bins, 0, -1):
        if a == bins:
            out.append((a,))
        for b in range(min(a, bins - a), 0, -1):
            if a + b == bins:
                out.append((a, b))
            for c in range(min(b, bins - a - b), 0, -1):
                if a + b + c == bins:
                    out.append((a, b, c))
                d = bins - a - b - c
                if 0 < d <= c and a % 4 == 0:
                    out.append((a, b, c, d))
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |ax - b|, x >= 0, by accelerated projected gradients."""
    gram, target = a.T @ a, a.T @ b
    step = 1 / max(np.linalg.norm(gram, 2), 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (gram @ y - target))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def plan(histogram: dict[int, int], size: int = SIZE, bins: int = BINS) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, count, first sequence, offset) that place every piece of the histogram.

    Rank r in [first, first + count) of the length goes to sequence first_sequence + r - first at the offset.
    Work and rows are bounded by the sequence length and the number of patterns, not by the counts.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    taken: dict[int, int] = defaultdict(int)
    rows, sequences = [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (first sequence, count) with that much room
    rooms: list[int] = []

    def place(n: int, count: int, first: int, offset: int) -> None:
        rows.append((n, taken[n], count, first, offset))
        taken[n] += count
        left[n] -= count

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            if not gaps[room]:
                bisect.insort(rooms, room)
            gaps[room].append((first, count))

    def take(room: int, most: int) -> tuple[int, int]:
        first, count = gaps[room].pop()
        if count > most:
            gaps[room].append((first, count - most))
            first, count = first + count - most, most
        if not gaps[room]:
            rooms.remove(room)
        return first, count

    # whole pieces first: each is a sequence
    if left.get(size):
        place(size, left[size], 0, 0)
        sequences = rows[-1][2]
    # repeat counts of patterns, fitted to the histogram of length classes
    classes = defaultdict(list)
    for n in left:
        if left[n]:
            classes[-(-n * bins // size)].append(n)
    shapes = [p for p in patterns(size, bins) if all(c in classes for c in p)]
    if shapes:
        a = np.zeros((bins + 1, len(shapes)))
        for j, p in enumerate(shapes):
            for c in p:
                a[c, j] += 1
        b = np.zeros(bins + 1)
        for c, ns in classes.items():
            b[c] = sum(left[n] for n in ns)
        fitted = nnls(a, b)
        for c in classes:
            classes[c].sort(reverse=True)
        for j in np.argsort(-fitted):
            whole = int(fitted[j])
            while whole > 0:
                # the longest lengths of the classes that are left, and last whatever fills the room best
                room, picks = size, []
                for k, c in enumerate(shapes[j], 1):
                    among = classes[c] if k < len(shapes[j]) else range(room, 0, -1)
                    n = next((n for n in among if n <= room and left.get(n, 0) > picks.count(n)), None)
                    if n is None:
                        break
                    picks.append(n)
                    room -= n
                if len(picks) < len(shapes[j]):
                    break
                count = min(whole, *(left[n] // picks.count(n) for n in picks))
                offset = 0
                for n in picks:
                    place(n, count, sequences, offset)
                    offset += n
                leave(room, sequences, count)
                sequences += count
                whole -= count
    # residuals by best fit, longest first
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect.bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                first, count = take(room, left[n])
                place(n, count, first, size - room)
                leave(room - n, first, count)
            else:
                each = size // n
                count = left[n] // each or 1
                each = min(each, left[n])
                for i in range(each):
                    place(n, count, sequences, i * n)
                leave(size - each * n, sequences, count)
                sequences += count
    return rows


def _place(shared, size: int):
    """(doc_id, piece, start, length, ids_crc32, rank) -> the same with sequence_id and offset for rank."""

    def run(batches):
        first, sequence, offset = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at, seq = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                here = length == n
                k = np.searchsorted(first[n], rank[here], "right") - 1
                at[here], seq[here] = offset[n][k], sequence[n][k] + rank[here] - first[n][k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(at)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def packed(spark: SparkSession, documents: DataFrame, vocabulary: str, size: int = SIZE, end: int = 0) -> DataFrame:
    """documents(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    A document is its ids and one id `end`; only longer ones are cut, into pieces of `size`. Null and empty
    texts are the one id `end`. Rows that repeat a doc_id or a text are packed each. Other columns are not read;
    an empty table gives an empty result. Pieces are written to the shared folder before they are ranked, so
    ranks don't change when a lost task is run again. The broadcast plan is bounded by `size` and the patterns.
    """
    tables = Tables(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    pieces = tables.keep(docs.mapInArrow(_cut(vocabulary, size, end), _PIECES), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row for each length, `size` at most
    first, sequence, offset = defaultdict(list), defaultdict(list), defaultdict(list)
    for n, rank, _, seq, at in plan({r[0]: r[1] for r in totals}, size):
        first[n].append(rank), sequence[n].append(seq), offset[n].append(at)
    shared = spark.sparkContext.broadcast([{n: np.array(v) for n, v in x.items()} for x in (first, sequence, offset)])
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (
        pieces.join(base, ["length", "task"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at")).alias("rank"))
        .mapInArrow(_place(shared, size), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
