"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact verification.

A document's set is its distinct k-word shingles. Signatures are compared in batches; after each batch a
pair goes when the posterior chance of similarity >= threshold, under a uniform prior and the matches so
far, is below the chosen miss probability. What survives is verified on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, among, binaries, mixed, text_or_empty
from .components import components

ROWS = 6  # minhash values in a band
MISS = 1e-7  # of a pair at the threshold: by the bands, and by each posterior bound
BATCH, BATCHES = 32, 4  # signature values compared at once, and how often; a byte each, so equal ones never differ
SMALL = 24  # buckets up to this size are compared whole; larger ones by leaders and components, with the same result
CROWD = 1000  # looked up under one item of a group; larger crowds become groups of their own, with the same result
ROUNDS = 6  # of such groups; then the pairs of a crowd are compared, with the same result
_K = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair at the threshold shares no band with chance `miss` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words than k make one shingle, none make none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(words))
    acc = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        acc = mixed(acc * _K + h[i : len(h) - n + 1 + i])
    return np.unique(acc)


def _signature(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    best = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(best, (low[i : i + 512, None] * mul + add).min(0), out=best)
    return best


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return (rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)), rng.integers(0, 1 << 32, n, np.uint32)


def _profiles(k: int, bands: int, rows: int):
    """(doc_id, text, key) -> doc_id, key, n_shingles, set_key, bands, sig; an empty set has null set_key."""

    def run(batches):
        mul, add = _constants(max(bands * rows, BATCH * BATCHES))
        order = np.random.default_rng(7).permutation(len(mul))[: BATCH * BATCHES]
        for batch in batches:
            n, set_key, band, sig = [], [], [], []
            for text in binaries(batch.column(1)):
                s = shingles(text, k)
                n.append(len(s))
                if not len(s):
                    set_key.append(None), band.append(None), sig.append(None)
                    continue
                set_key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                m = _signature(s, mul, add)
                acc = np.arange(1, bands + 1, dtype=np.uint64) * _K
                for r in m[: bands * rows].reshape(bands, rows).T:
                    acc = mixed(acc ^ r.astype(np.uint64)) * _K
                band.append(acc.view(np.int64))
                sig.append(m[order].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(set_key, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                ["doc_id", "key", "n_shingles", "set_key", "bands", "sig"],
            )

    return run


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """After each batch: the fewest matches at which P(similarity >= threshold | matches) is still >= miss."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for i in range(1, BATCHES + 1):
        n = BATCH * i
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() / p.sum() >= miss:
                break
        out.append(m)
    return out


def _bayes(threshold: float, miss: float):
    """(a, b, sig_a, sig_b) -> the pairs (a, b) that no posterior bound prunes."""

    def run(batches):
        least = least_matches(threshold, miss)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (batch.column(2), batch.column(3)))
            left, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, m in enumerate(least):
                at = slice(i * BATCH, (i + 1) * BATCH)
                matches[left] += (x[left, at] == y[left, at]).sum(1)
                left = left[matches[left] >= m]
            yield batch.select([0, 1]).take(pa.array(left))

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            sets = pa.array((shingles(t, k).tobytes() for t in binaries(batch.column(1))), pa.binary(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["id", "shingles"])

    return run


def _hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """Views of the sets in a column of binaries, without copies."""
    at, data = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1], column.buffers()[2] or b""
    return (np.frombuffer(data, np.uint64, (e - b) // 8, b) for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _exact(num: int, den: int):
    """(a, b, set_a, set_b) -> the pairs (a, b) with den * intersection >= num * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for i, (s, t) in enumerate(zip(_hashes(batch.column(2)), _hashes(batch.column(3)), strict=True)):
                if den * min(len(s), len(t)) < num * max(len(s), len(t)):
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                if den * both >= num * (len(s) + len(t) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _pair(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _side(t: DataFrame, i: str, c: str) -> DataFrame:
    return t.select(F.col("id").alias(i), F.col(c).alias(f"{c}_{i}"))


def _sets_of(spark: SparkSession, docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The sets of the classes wanted(id, doc_id, key), from the text of one row each. Other texts are left out by a
    filter before the join deals them out."""
    some = docs.where(among(spark, wanted.select("key"), F.col("key"))).join(wanted, ["doc_id", "key"]).select("doc_id", "key", "id", "text").distinct()
    return some.select("id", "text").mapInArrow(_sets(k), "id long, shingles binary")


def _same_document(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of the classes that rows of one doc_id are in, each with the first of them."""
    hashed = F.xxhash64("set_key")
    repeated = members.where("doc_id IS NOT NULL AND set_key IS NOT NULL").groupBy("doc_id").agg(F.min(hashed).alias("x"), F.max(hashed).alias("y")).where("x <> y").select("doc_id")
    held = members.join(repeated, "doc_id", "left_semi").join(classes, "set_key").select("doc_id", "id").distinct()
    first = held.groupBy("doc_id").agg(F.min("id").alias("first"))
    return held.join(first, "doc_id").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))


def _survivors(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) whose signatures don't rule a link out."""
    met = pairs.join(_side(sigs, "a", "sig"), "a").join(_side(sigs, "b", "sig"), "b").select("a", "b", "sig_a", "sig_b")
    return met.mapInArrow(_bayes(threshold, miss), "a long, b long").distinct()


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""
    met = pairs.join(_side(sets, "a", "shingles"), "a").join(_side(sets, "b", "shingles"), "b").select("a", "b", "shingles_a", "shingles_b")
    return met.mapInArrow(_exact(num, den), "a long, b long").distinct()


def _differences(num: int, den: int):
    """(leader, id, ..., set_leader, set) -> the columns between, the set's size, the leader's, whether they are not
    linked, and what is in one of them only."""

    def run(batches):
        for batch in batches:
            own, other, far, parts = [], [], [], []
            for s, t in zip(_hashes(batch.column("shingles_leader")), _hashes(batch.column("shingles_id")), strict=True):
                one = np.setxor1d(s, t, assume_unique=True).view(np.int64)
                both = (len(s) + len(t) - len(one)) // 2
                own.append(len(t)), other.append(len(s)), far.append(den * both < num * (both + len(one))), parts.append(one)
            kept = [n for n in batch.schema.names if not n.startswith("shingles_")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(own, pa.int64()), pa.array(other, pa.int64()), pa.array(far, pa.bool_()), pa.array(parts, pa.list_(pa.int64()))],
                [*kept, "size", "lead", "far", "apart"],
            )

    return run


def _one_leader(groups: DataFrame, label: DataFrame) -> DataFrame:
    """(leader, id, main) of groups (leader, id): those whose leaders are in one component (main) become one group,
    led by the leader of most. A member of many buckets of one component is then looked at once."""
    led = groups.groupBy("leader").agg(F.count("*").alias("n")).join(label.withColumnsRenamed({"id": "leader", "c": "main"}), "leader", "left").select("leader", "n", F.coalesce("main", "leader").alias("main"))
    most = led.groupBy("main").agg(F.max(F.struct("n", "leader"))["leader"].alias("most"))
    return groups.join(led.join(most, "main").select("leader", "most", "main"), "leader").select(F.col("most").alias("leader"), "id", "main").distinct()


def _left_over(groups: DataFrame, found: DataFrame, sets: DataFrame, num: int, den: int, tables: Tables, nth: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of groups (leader, id) that could be links between two components, and new groups of those who
    share an item with a crowd; exact, and linear in a group.

    Write D(u) for what only one of u and the leader holds. Then |u xor v| = |D(u) xor D(v)|, and u and v are linked
    if it is at most T = (den - num) * (|u| + |v|) / (den + num). So D(u) and D(v) share (|D(u)| + |D(v)| - T) / 2
    at least, and the first they share, in any order, is among the first (|D(u)| - |D(v)| + T) / 2 + 1 of D(u) and
    (|D(v)| - |D(u)| + T) / 2 + 1 of D(v). Ordered from rare to common, those are mostly what each alone has, however
    much the group has in common. Who isn't linked with the leader is looked up (v); a linked one only looks (u), as
    does the one with the smaller D of two who aren't. Sizes of D that differ by more than T make no link, so no one
    is looked up under more than T + 1 items. Where more than CROWD are looked up under an item, the pairs that meet
    there aren't made: all who meet there become a group of their own, led by one of them, who is like them in that
    item at least. Items whose members are in one component are left.
    """
    label = found.withColumnRenamed("component", "c")
    joint = _one_leader(groups, label) if not nth else groups.join(label.withColumnsRenamed({"id": "leader", "c": "main"}), "leader", "left").select("leader", "id", F.coalesce("main", "leader").alias("main"))
    marked = joint.join(label.withColumnRenamed("c", "own"), "id", "left").select("leader", "id", F.coalesce("own", "id").alias("own"), "main")
    split = marked.where("own <> main").select("leader").distinct()
    members = tables.keep(marked.where(F.col("id") != F.col("leader")).join(split, "leader", "left_semi"), f"members-{nth}")
    apart = tables.keep(
        members.join(_side(sets, "leader", "shingles"), "leader").join(_side(sets, "id", "shingles"), "id")
        .select("leader", "id", "own", "main", "shingles_leader", "shingles_id").mapInArrow(_differences(num, den), "leader long, id long, own long, main long, size long, lead long, far boolean, apart array<long>"),
        f"apart-{nth}",
    )
    items = apart.select("leader", "id", "own", "far", "size", F.size("apart").alias("y"), "lead", F.explode("apart").alias("item"))
    common = items.groupBy("leader", "item").agg(F.count("*").alias("n")).where("n > 1")
    spread = den - num, den + num
    least = F.floor(spread[0] * (F.col("size") * num / den + F.col("lead")) / spread[1])
    most = F.floor(spread[0] * (F.col("size") + F.col("size") * den / num) / spread[1])
    first = F.floor((F.col("y") - F.when(F.col("far"), F.greatest("y", least)).otherwise(least) + most) / 2) + 2
    found_under = F.floor((F.col("y") - F.greatest(F.col("y") - most, F.lit(0)) + most) / 2) + 2
    # what one member alone has comes first in the order, and only its number matters
    own_window = Window.partitionBy("leader", "id")
    place = F.col("y") - F.count("*").over(own_window) + F.row_number().over(own_window.orderBy("n", "item"))
    rows = items.join(common, ["leader", "item"]).withColumn("place", place)
    placed = tables.keep(rows.withColumn("looks", F.col("place") <= first).where((F.col("far") & (F.col("place") <= found_under)) | F.col("looks")).drop("lead"), f"placed-{nth}")
    met = placed.groupBy("leader", "item").agg(F.count_if("far").alias("sought"), F.min("own").alias("x"), F.max("own").alias("y")).where("sought > 0 AND x <> y")
    split_items = tables.keep(met.select("leader", "item", (F.col("sought") > (CROWD if nth < ROUNDS else 2**62)).alias("crowd")), f"kinds-{nth}")
    crowds = placed.join(split_items.where("crowd"), ["leader", "item"], "left_semi").select("leader", "item", "id")
    shares = crowds.groupBy("leader", "id").agg(F.count("*").alias("spread"))
    leads = crowds.join(shares, ["leader", "id"]).groupBy("leader", "item").agg(F.max(F.struct("spread", "id"))["id"].alias("new"))
    crowds = crowds.join(leads, ["leader", "item"]).select(F.col("new").alias("leader"), "id").distinct()
    placed = placed.join(split_items.where("NOT crowd"), ["leader", "item"], "left_semi")
    sought = placed.where("far").select("leader", "item", F.col("id").alias("v"), F.col("own").alias("v_own"), F.col("size").alias("v_size"), F.col("y").alias("x"), F.col("place").alias("v_place"))
    within = F.floor(spread[0] * (F.col("size") + F.col("v_size")) / spread[1])
    pairs = placed.where("looks").join(
        sought.withColumnsRenamed({"leader": "v_leader", "item": "v_item"}),
        (F.col("leader") == F.col("v_leader")) & (F.col("item") == F.col("v_item")) & (F.col("own") != F.col("v_own"))
        & (~F.col("far") | (F.struct("x", "v") > F.struct("y", "id"))) & (F.col("place") <= F.floor((F.col("y") - F.col("x") + within) / 2) + 1) & (F.col("v_place") <= F.floor((F.col("x") - F.col("y") + within) / 2) + 1),
    )
    # one that is linked with the leader of the joint group, but met it in no bucket
    alone = apart.where("NOT far AND own <> main")
    return pairs.select(*_pair(F.col("id"), F.col("v"))).unionByName(alone.select(*_pair(F.col("id"), F.col("leader")))).distinct(), crowds


def near_duplicates(spark: SparkSession, documents: DataFrame, k: int = 5, num: int = 80, den: int = 100, miss: float = MISS, rows: int = ROWS) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_shingles, component_id, kept: one row for each input row.

    Documents are linked when den * |intersection| >= num * |union| of their shingle sets. component_id is the
    smallest doc_id reachable over links; kept tells that it is the row's own. Null and empty texts, and texts
    without words, have no shingles and are linked with nothing. Rows that repeat a doc_id count as one
    document, linked with whatever one of its texts is, and get the same component_id; a null doc_id keeps a null component_id if nothing else has its
    set. Other columns are not read. An empty table gives an empty result.

    Rows with the same set are one class from the start, with a number of its own. Buckets of two are a pair; up to
    SMALL members are compared whole; in larger ones all members are compared with a leader, the one that meets
    most others. Links found so far are closed to components, and in groups that are still split, _left_over() finds
    every pair that could join two components, or smaller groups that are looked at in the same way. So no link that
    matters is left uncompared, no group is gathered, and no group's pairs are made.
    """
    tables = Tables(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("key", F.xxhash64("text"))
    bands = bands_for(num / den, rows, miss)
    profiles = tables.keep(docs.mapInArrow(_profiles(k, bands, rows), "doc_id long, key long, n_shingles long, set_key binary, bands array<long>, sig binary"), "profiles")
    members = tables.keep(profiles.select("doc_id", "n_shingles", "set_key"), "documents")
    # rows with the same set have the same bands and signature; the smallest of them stands for the class
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    classes = profiles.where("set_key IS NOT NULL").groupBy("set_key").agg(least.alias("least"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    classes = tables.keep(classes.select(F.monotonically_increasing_id().alias("id"), "set_key", "least.doc_id", "least.key", "bands", "sig"), "signatures")
    tables.drop("profiles")
    sigs = classes.where("doc_id IS NOT NULL").select("id", "sig", "bands")

    banded = sigs.select("id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("x"), F.max("id").alias("y")).where("n > 1 AND x < y")
    buckets = tables.keep(buckets, "buckets")
    many = tables.keep(banded.join(buckets.where("n > 2").select("band", "n"), "band"), "bucketed")
    twos = buckets.where("n = 2").select(*_pair(F.col("x"), F.col("y")))
    small = (
        many.where(F.col("n") <= SMALL).groupBy("band").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        .select("ids", F.posexplode("ids").alias("i", "a"))
        .select("a", F.explode(F.slice("ids", F.col("i") + 2, SMALL)).alias("b"))
    )
    large = many.where(F.col("n") > SMALL)
    spread = large.groupBy("id").agg(F.sum("n").alias("spread"))
    leaders = large.join(spread, "id").groupBy("band").agg(F.max(F.struct("spread", "id"))["id"].alias("leader"))
    groups = tables.keep(large.join(leaders, "band").select("leader", "id").distinct(), "groups")
    led = groups.where(F.col("id") != F.col("leader")).select(*_pair(F.col("id"), F.col("leader")))
    pairs = tables.keep(twos.unionByName(small).unionByName(led).distinct(), "pairs")
    near = tables.keep(_survivors(pairs, sigs, num / den, miss), "survivors")
    # sets of all that may be compared, so that texts are dealt out once
    compared = near.select(F.explode(F.array("a", "b")).alias("id")).unionByName(groups.select("id")).distinct()
    wanted = tables.keep(compared.join(classes.select("id", "doc_id", "key"), "id"), "compared")
    sets = tables.keep(_sets_of(spark, docs, wanted, k), "sets")
    links = tables.keep(_links(near, sets, num, den).unionByName(_same_document(members, classes.select("set_key", "id"))), "links")
    found, nth = components(tables, links, "components-0"), 0
    while True:
        rest, crowds = _left_over(groups, found, sets, num, den, tables, nth)
        groups = tables.keep(crowds, f"crowds-{nth}")
        rest = tables.keep(rest.unionByName(groups.where("id <> leader").select(*_pair(F.col("id"), F.col("leader")))).distinct().join(pairs, ["a", "b"], "left_anti"), f"rest-{nth}")
        tables.drop(f"members-{nth}", f"apart-{nth}", f"placed-{nth}", f"kinds-{nth}")
        nth += 1
        if not rest.isEmpty():
            more = tables.keep(_links(_survivors(rest, sigs, num / den, miss), sets, num, den), f"more-{nth}")
            links = links.unionByName(more)
            found = components(tables, links, f"components-{nth}")
        if groups.isEmpty():
            break
    tables.drop("buckets", "bucketed", "groups", "pairs", "survivors", "compared", "sets", "links", *(f"{x}-{i}" for i in range(nth + 1) for x in ("crowds", "rest", "more")))
    known = classes.select("id", "set_key", F.col("doc_id").alias("least"))
    found = found.unionByName(found.select("component").distinct().select(F.col("component").alias("id"), "component"))
    smallest = tables.keep(found.join(known, "id").groupBy("component").agg(F.min("least").alias("smallest")), "smallest")
    named = members.join(known, "set_key", "left").join(found.join(smallest, "component").select("id", "smallest"), "id", "left")
    named = named.select("doc_id", "n_shingles", F.coalesce("smallest", "least", "doc_id").alias("component_id"))
    # rows without words of a doc_id that has words elsewhere
    bare = members.where("set_key IS NULL AND doc_id IS NOT NULL").select("doc_id").distinct()
    mixed_ids = tables.keep(members.where("set_key IS NOT NULL").join(bare, "doc_id", "left_semi").select("doc_id").distinct(), "bare")
    if not mixed_ids.isEmpty():
        theirs = named.where("n_shingles > 0").join(mixed_ids, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("theirs"))
        named = named.join(theirs, "doc_id", "left").withColumn("component_id", F.coalesce("theirs", "component_id")).drop("theirs")
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
