"""Approximate nearest neighbours with a hash-prefix forest.

Each tree is the sorted array of long hash strings (random hyperplane bits) of all vectors, cut into segments
by range partitioning, so that one common vector fills many segments rather than one. A query first descends:
in each tree it goes to the segment where its own string belongs and looks at its neighbours there, which
share the longest prefixes with it. From the similarity of the k-th best so far follows how short a prefix
must be for a vector at least as near to be missed by all trees with no more than the chosen chance; all
trees then ascend together to that depth and every row under the prefix is looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables

TREES = 8
BITS = 48
MISS = 0.05  # chance that all trees miss a vector as near as the k-th best
SEGMENT = 16_384  # rows of a segment, about
NEAR = 512  # neighbours looked at on either side when a query descends
QUERIES = 32_768  # queries handled with a segment at once, about; a segment that more ask for is read that many times more often


def _planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(97).standard_normal((dim, trees * BITS))


def _vectors(column, single: bool) -> np.ndarray:
    """Vectors in double precision from bytes of floats or doubles."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float32 if single else np.float64).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _hashed(dim: int, trees: int, single: bool):
    """(vec_id, embedding) -> vec_id, vector (bytes of floats or doubles), codes; vectors that take no part are left out."""

    def run(batches):
        planes, weights = _planes(dim, trees), 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            lists = batch.column(1).cast(pa.list_(pa.float64()))
            size = np.diff(lists.offsets.to_numpy())
            ok = (size == dim) & lists.is_valid().to_numpy(zero_copy_only=False)
            ids, x = batch.column(0).filter(pa.array(ok)), lists.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            ids, x = ids.filter(pa.array(ok)), np.ascontiguousarray(x[ok])
            bits = (x @ planes > 0).reshape(len(x), trees, BITS)
            codes = bits @ weights
            yield pa.RecordBatch.from_arrays([ids, pa.array([v.tobytes() for v in (x.astype(np.float32) if single else x)], pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))], ["vec_id", "vector", "codes"])

    return run


def least_cosine(depth: int, trees: int, miss: float = MISS) -> float:
    """The similarity from which on all trees miss a vector under a prefix of that depth with chance miss at most."""
    same = (1 - miss ** (1 / trees)) ** (1 / depth)  # chance that one bit agrees
    return math.cos(math.pi * (1 - same))


def _best(q: np.ndarray, qn: float, v: np.ndarray, ids: np.ndarray, near: np.ndarray, own: int, k: int):
    """The k nearest of candidates with approximate cosines `near`: ids and exact cosines, ties to smaller ids."""
    others = ids != own
    near = np.where(others, near, -np.inf)
    n = int(others.sum())
    if n > k:
        least = np.partition(near, len(near) - k)[len(near) - k] - 1e-9
        at = np.flatnonzero(near >= least)
    else:
        at = np.flatnonzero(others)
    x = v[at]
    exact = (x * q).sum(1) / (qn * np.sqrt((x * x).sum(1)))
    order = np.lexsort((ids[at], -exact))[:k]
    return ids[at][order], exact[order]


def _search(k: int, descend: bool, single: bool):
    """A segment's rows (tree, code, vec_id, vector) and its queries (query_id, vector, code, low, high): the k
    nearest for each query among its neighbours in the sorted array (descend) or among codes in [low, high]."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if rows.num_rows and queries.num_rows:
            code, ids = rows["code"].to_numpy(), rows["vec_id"].to_numpy()
            order = np.lexsort((ids, code))
            code, ids, v = code[order], ids[order], _vectors(rows["vector"].combine_chunks(), single)[order]
            unit = v / np.sqrt((v * v).sum(1))[:, None]
            names, qs = queries["query_id"].to_numpy(), _vectors(queries["vector"].combine_chunks(), single)
            if descend:
                at = np.searchsorted(code, queries["code"].to_numpy())
                begin, end = np.maximum(at - NEAR, 0), np.minimum(at + NEAR, len(code))
            else:
                begin = np.searchsorted(code, queries["low"].to_numpy(), "left")
                end = np.searchsorted(code, queries["high"].to_numpy(), "right")
            norms = np.sqrt((qs * qs).sum(1))
            for b, e in {*zip(begin.tolist(), end.tolist())}:
                if b >= e:
                    continue
                of = np.flatnonzero((begin == b) & (end == e))
                for i in range(0, len(of), 128):
                    part = of[i : i + 128]
                    for j, near in zip(part, (qs[part] / norms[part, None]) @ unit[b:e].T):
                        found, score = _best(qs[j], norms[j], v[b:e], ids[b:e], near, names[j], k)
                        out_q += [names[j]] * len(found)
                        out_v += found.tolist()
                        out_s += score.tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with rank."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(spark: SparkSession, vectors: DataFrame, every: int = 50, k: int = 5, trees: int = TREES, miss: float = MISS) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score: for rows whose vec_id is divisible by `every`.

    score is the cosine in double precision; nearest first, ties to the smaller vec_id. Null vec_ids, and
    vectors that are null, zero, of another length than most, or hold null or non-finite components take no part.
    Rows that repeat a vec_id count as one candidate, at the nearest of them; a query that repeats is searched
    with its first vector in byte order, and is never its own candidate. Other columns are not read.
    """
    tables = Tables(spark)
    # floats are kept as floats in the index, which is half of doubles, and made doubles where they are compared
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    sizes = given.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes or not sizes[0]["dim"]:
        return empty
    dim, n = sizes[0]
    hashed = tables.keep(given.mapInArrow(_hashed(dim, trees, single), "vec_id long, vector binary, codes array<long>"), "hashed")
    many = max(trees, math.ceil(trees * n / SEGMENT))
    index = hashed.select("vec_id", "vector", F.posexplode("codes").alias("tree", "code")).repartitionByRange(many, "tree", "code", "vec_id").withColumn("part", F.spark_partition_id())
    index = tables.keep(index.withColumn("segment", F.col("part") * trees + F.col("tree")).drop("part"), "index")
    # a row for each segment, so bounded by the number of partitions and trees
    segments = F.broadcast(index.groupBy("segment", "tree").agg(F.min("code").alias("first"), F.max("code").alias("last")).toDF("at", "of", "first", "last"))

    asked = hashed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vector", "codes")).alias("q"))
    asked = tables.keep(asked.select(F.col("vec_id").alias("query_id"), "q.vector", "q.codes"), "queries")

    def search(queries: DataFrame, meets, descend: bool) -> DataFrame:
        to = queries.join(segments, meets).select(F.col("at").alias("segment"), "query_id", "vector", "code", "low", "high")
        # a row for each segment: only one that many queries ask for is copied, and only for blocks of those
        asking = F.broadcast(to.groupBy("segment").agg((1 + F.floor(F.count("*") / QUERIES)).alias("blocks")))
        block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block")
        to = to.join(asking, "segment").select("segment", block, "query_id", "vector", "code", "low", "high")
        asked_for = index.join(asking, "segment").select("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "code", "vec_id", "vector")
        return (
            asked_for.groupBy("segment", "block").cogroup(to.groupBy("segment", "block"))
            .applyInArrow(_search(k, descend, single), "query_id long, vec_id long, score double")
        )

    same = F.col("tree") == F.col("of")
    down = asked.select("query_id", "vector", F.posexplode("codes").alias("tree", "code")).withColumn("low", F.col("code")).withColumn("high", F.col("code"))
    # where the string itself belongs; where it falls between two segments, the ascent finds it
    first = tables.keep(_nearest(search(down, same & (F.col("code") >= F.col("first")) & (F.col("code") <= F.col("last")), True), k), "descended")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    depth = F.lit(0)
    for d in range(1, BITS + 1):  # the greatest depth at which a vector as near as the k-th best is seldom missed
        depth = F.when(F.col("kth") >= least_cosine(d, trees, miss), d).otherwise(depth)
    up = asked.join(kth, "query_id", "left").withColumn("free", F.lit(BITS) - depth)
    mask = F.expr("shiftleft(1L, free) - 1")
    up = up.select("query_id", "vector", "free", F.posexplode("codes").alias("tree", "code")).withColumn("low", F.col("code").bitwiseAND(F.bitwise_not(mask))).withColumn("high", F.col("code").bitwiseOR(mask))
    second = search(up, same & (F.col("low") <= F.col("last")) & (F.col("high") >= F.col("first")), False)
    found = _nearest(second.unionByName(first.select("query_id", "vec_id", "score")), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
