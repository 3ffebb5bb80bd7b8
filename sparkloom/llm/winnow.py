"""Document fingerprints by winnowing, and how like each text's fingerprint is to those of other texts.

Every GRAM code points in a row are hashed, and of every WINDOW hashes in a row the smallest is kept, the rightmost
of equal ones, with its position. Two texts that share GRAM + WINDOW - 1 code points in a row share a fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, text_or_empty

GRAM = 16
WINDOW = 48
SPLITTERS = 65_536  # ranges of ids that are dealt out, at most
SAMPLE = 20  # ids that are looked at for each of them
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def rolled(codes: np.ndarray, gram: int) -> np.ndarray:
    """The polynomial hash of every `gram` numbers in a row, modulo 2^64: runs of 1, 2, 4, ... are joined."""
    runs, size, done, have = codes.astype(np.uint64), 1, None, 0
    while True:
        if gram & size:
            at = len(codes) - have - size + 1
            power = np.uint64(pow(_BASE, size, 1 << 64))
            done = runs[:at] if done is None else done[:at] * power + runs[have : have + at]
            have += size
        if size * 2 > gram:
            return done
        power = np.uint64(pow(_BASE, size, 1 << 64))
        runs, size = runs[:-size] * power + runs[size:], size * 2


def winnowed(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes and their positions (of the first code point), ascending. A text shorter than `gram` is one
    gram, one with fewer grams than `window` one window, and an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = mixed(rolled(codes, min(gram, len(codes)))) >> np.uint64(32)
    least = (hashes << np.uint64(32)) | (_LOW - np.arange(len(hashes), dtype=np.uint64))  # of equal hashes, the last is least
    size, window = 1, min(window, len(hashes))
    while size * 2 <= window:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < window:
        least = np.minimum(least[: len(hashes) - window + 1], least[window - size :])
    kept = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return kept >> np.uint64(32), (_LOW - (kept & _LOW)).astype(np.int64)


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    return " ".join(f"{h:08x}@{at}" for h, at in zip(hashes.tolist(), positions.tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes to all hashes of both, and 1 for two fingerprints without any."""
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a or b else 1.0


def fingerprints(spark: SparkSession, documents: DataFrame, gram: int = GRAM, window: int = WINDOW, ranges: int | None = None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next:
    one row for each input row.

    The edited text is a text with its last half replaced by the first as many code points of the next document's, or by
    all of it. Next means in descending order of doc_id, null last, and after the last the first; rows that repeat a
    doc_id follow each other by a hash of their texts, and equal rows are next to each other. A fingerprint is
    written as hash@position by position, apart by blanks. A null text is empty, an empty one has no fingerprint, and two without any are alike (1).
    A single row is its own next. An empty table gives an empty result. Other columns are not read.

    Ids are dealt out in ranges between ids of a sample, and the first document of each range is sent to the range
    before it as well, so a text moves once. An id that holds more rows than a range is divided by its texts' hashes;
    equal rows stay in one range, which is walked without being held.
    """
    # ascending: ~doc_id descends, and a null comes after all; the second key counts where ids repeat
    none = F.col("doc_id").isNull()
    key = F.when(none, F.lit(2**63 - 1)).otherwise(F.bitwise_not("doc_id")).alias("key")
    second = (F.shiftrightunsigned(F.xxhash64("text"), 2) + F.when(none, F.lit(2**62)).otherwise(F.lit(0))).alias("second")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    starts = _starts(spark, rows, key, second, ranges)
    if not starts:
        return spark.createDataFrame([], _RESULT)
    divided = any(a[0] == b[0] for a, b in zip(starts, starts[1:]))
    shared = spark.sparkContext.broadcast((np.array([k for k, _ in starts]), np.array([s for _, s in starts])))

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series, seconds: pd.Series) -> pd.Series:
        """The range of a row, and the one before too if the row is the first of its range."""
        first, then = shared.value
        k, s, n = keys.to_numpy(), seconds.to_numpy(), len(first)
        low, at = np.searchsorted(first, k, "left"), np.searchsorted(first, k, "right") - 1
        for i in np.flatnonzero(at > low):  # a divided id
            at[i] = max(low[i] - 1, low[i] + np.searchsorted(then[low[i] : at[i] + 1], s[i], "right") - 1)
        heads = (first[at] == k) & (then[at] == s)
        return pd.Series([[a, (a - 1) % n + n] if head else [a] for a, head in zip(at.tolist(), heads.tolist())])

    n = len(starts)
    dealt = rows.select("doc_id", "text", key, second).withColumn("at", F.explode(places("key", "second" if divided else F.lit(0).cast("long"))))
    dealt = dealt.withColumn("range", F.col("at") % n).withColumn("copy", F.col("at") >= n)
    walked = dealt.repartition("range").sortWithinPartitions("range", "copy", "key", "second", "text").select("range", "copy", "doc_id", "text")
    return walked.mapInArrow(_walk(gram, window), _RESULT)


def _starts(spark: SparkSession, rows: DataFrame, key, second, ranges: int | None) -> list[tuple[int, int]]:
    """The first keys of the ranges, from a sample of bounded size; the very first row begins the first of them.
    Texts are read for it only if an id of the sample begins more than one range."""
    n = rows.count()
    if not n:
        return []
    ranges = ranges or min(SPLITTERS, 4 * max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    least = rows.agg(F.max("doc_id")).first()[0]

    def chosen(then) -> list[tuple[int, int]]:
        whose = F.col("doc_id").eqNullSafe(F.lit(least).cast("long"))
        first = (2**63 - 1 if least is None else ~least, 0 if then is None else rows.where(whose).agg(F.min(second)).first()[0])
        some = rows.sample(min(1.0, SAMPLE * ranges / n), seed=1).select(key, F.lit(0).cast("long").alias("second") if then is None else then)
        found = sorted(map(tuple, some.collect()))
        return [first, *(x for x in found[SAMPLE - 1 :: SAMPLE] if x > first)]

    found = chosen(None)
    if len({k for k, _ in found}) < len(found):
        found = chosen(second)
    return sorted(set(found))


def _walk(gram: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RESULT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out: list[tuple] = []
        size, before = 0, None  # the row that waits for its next: range, copy, doc_id, text, hashes, positions
        for batch in batches:
            for i in range(batch.num_rows):
                at, copy, doc_id, text = (c[i].as_py() for c in batch.columns)
                if copy and (before is None or before[1]):
                    continue  # a first row was there already
                row = (at, copy, doc_id, text, *winnowed(text, gram, window))
                if before is not None and not before[1]:
                    out.append(_compared(before, row, gram, window))
                    size += len(out[-1][3]) + len(out[-1][4])
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, size = [], 0
                before = row
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def _compared(row: tuple, after: tuple, gram: int, window: int) -> tuple:
    _, _, doc_id, text, hashes, positions = row
    half = len(text) // 2
    edited = text[: len(text) - half] + after[3][:half]
    other = winnowed(edited, gram, window)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(hashes, positions), written(*other), likeness(hashes, other[0]), likeness(hashes, after[4])
