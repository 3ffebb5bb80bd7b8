"""Near-duplicate images across a file of any size: bands of the hash find who may meet, and a walk in order decides.

An image joins the first kept one that looks like it, and the larger takes the place, so the outcome hangs on the order.
But an image only ever meets images that some chain of look-alikes ties it to; each such component is walked by itself, as
a stream that holds what was kept and not what was seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .images import hamming

HOT = 64  # different hashes with one band, above which two words have to agree


def _bands(h: Column, bits: int) -> Column:
    """bits + 1 pieces of a hash of 64 hexadecimal digits, apart by place: of two hashes that differ in `bits` bits, one is equal."""
    ends = [64 * i // (bits + 1) for i in range(bits + 2)]
    return F.array(*(F.concat(F.lit(f"{i}:"), F.substring(h, a + 1, b - a)) for i, (a, b) in enumerate(zip(ends, ends[1:]))))


def _pairs_of_words(h: Column, bits: int) -> Column:
    """Every two of bits + 2 pieces: of such hashes, two pieces at least are equal."""
    ends = [64 * i // (bits + 2) for i in range(bits + 3)]
    words = [F.substring(h, a + 1, b - a) for a, b in zip(ends, ends[1:])]
    return F.array(*(F.concat_ws(":", F.lit(f"{i}+{j}"), words[i], words[j]) for i, j in combinations(range(len(words)), 2)))


def linked_hashes(hashes: DataFrame, bits: int) -> DataFrame:
    """hashes(doc, h), each once -> doc, a, b with a < b: all pairs of a document that differ in `bits` bits at most."""
    near = lambda keys: keys.select("doc", F.col("h").alias("a"), "key").join(keys.select("doc", F.col("h").alias("b"), "key"), ["doc", "key"]).where(F.col("a") < F.col("b"))
    keyed = hashes.select("doc", "h", F.explode(_bands(F.col("h"), bits)).alias("key"))
    crowded = kept(keyed.groupBy("doc", "key").count().where(F.col("count") > HOT).select("doc", "key"), "crowded")
    few = near(keyed.join(crowded, ["doc", "key"], "left_anti"))
    # hashes with a crowded band meet where two words agree, whatever the band
    many = near(keyed.join(crowded, ["doc", "key"], "left_semi").select("doc", "h").distinct().select("doc", "h", F.explode(_pairs_of_words(F.col("h"), bits)).alias("key")))
    return few.unionByName(many).select("doc", "a", "b").distinct().where(hamming(F.col("a"), F.col("b")) <= bits)


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(doc, h), links(doc, a, b) -> doc, h, c: the smallest hash that links lead to. A round takes the least label of
    the neighbours, and then that label's own; it ends when none changes."""
    both = kept(links.unionByName(links.select("doc", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = kept(nodes.withColumn("c", F.col("h")), "labels")
    while True:
        offered = both.join(labels.select("doc", F.col("h").alias("b"), "c"), ["doc", "b"]).groupBy("doc", F.col("a").alias("h")).agg(F.min("c").alias("o"))
        least = labels.join(offered, ["doc", "h"], "left").select("doc", "h", "c", F.least("c", "o").alias("n"))
        own = labels.select("doc", F.col("h").alias("n"), F.col("c").alias("m"))
        now = kept(least.join(own, ["doc", "n"]).select("doc", "h", F.least("n", "m").alias("c"), (F.least("n", "m") != F.col("c")).alias("changed")), "labels")
        labels = now.select("doc", "h", "c")
        if now.where("changed").isEmpty():
            return labels


def _walk(bits: int, aspect: float):
    """Rows by component and order (c, id, h, width, height) -> (id, c, slot) for each, and (null, c, slot, kept) for each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        where, slots = None, []  # (hash, shape, area, id) of what is kept

        def ended() -> None:
            out.extend((None, where, i, s[3]) for i, s in enumerate(slots))

        for batch in batches:
            for c, id_, h, width, height in zip(*(batch.column(n).to_pylist() for n in ("c", "id", "h", "width", "height"))):
                if c != where:
                    ended()
                    where, slots = c, []
                mine = (int(h, 16), width / max(height, 1), width * height, id_)
                at = next((i for i, s in enumerate(slots) if abs(mine[1] - s[1]) <= aspect and (mine[0] ^ s[0]).bit_count() <= bits), None)
                if at is None:
                    at = len(slots)
                    slots.append(mine)
                elif mine[2] > slots[at][2]:
                    slots[at] = mine
                out.append((id_, c, at, None))
            yield _batch(out)
            out = []
        ended()
        yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["id", "c", "slot", "kept"])


def near_images(images: DataFrame, bits: int = 6, aspect: float = 0.01) -> DataFrame:
    """images(doc, position, image_id, visual_hash, width, height) -> doc, image_id, kept_id: one row for each input row.

    In order of position and image_id, an image joins the first kept one of its document whose hash differs in `bits`
    of 256 bits at most and whose ratio of sides differs by `aspect` at most; the larger of both takes the place. Hashes
    are 64 hexadecimal digits. Rows without a doc or a hash are groups of their own; rows that repeat are images of
    their own; an empty table gives an empty result. Other columns are not read.
    """
    rows = kept(images.select(F.monotonically_increasing_id().alias("id"), "doc", "position", "image_id", F.lower("visual_hash").alias("h"), F.col("width").cast("double"), F.col("height").cast("double")), "images")
    whole = rows.where("doc IS NOT NULL AND h IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")
    hashes = kept(whole.select("doc", "h").distinct(), "hashes")
    labels = _components(hashes, linked_hashes(hashes, bits))
    placed = whole.join(labels.select("doc", "h", F.concat_ws(":", F.col("c"), F.col("doc").cast("string")).alias("c")), ["doc", "h"])
    walked = kept(placed.repartition("c").sortWithinPartitions("c", "position", "image_id", "id").select("c", "id", "h", "width", "height").mapInArrow(_walk(bits, aspect), "id long, c string, slot long, kept long"), "walked")
    ends = walked.where("id IS NULL").select("c", "slot", F.col("kept").alias("end"))
    joined = walked.where("id IS NOT NULL").select("id", "c", "slot").join(ends, ["c", "slot"]).select("id", "end")
    names = rows.select(F.col("id").alias("end"), F.col("image_id").alias("kept_id"))
    return rows.join(joined, "id", "left").withColumn("end", F.coalesce("end", "id")).join(names, "end").select("doc", "image_id", "kept_id")
