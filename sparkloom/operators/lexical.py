"""A stored TF-IDF index and its search.

Texts are dealt into tiles by their ids. The index has a row for each term and text: the term's weight in it (unit
vectors). Rows lie in buckets by term and are sorted by term and tile, so a search reads the buckets of its terms only.
It goes through tiles with the k best scores so far, and leaves out a tile for a query where the largest weights that
its terms have there can't add up to the k-th.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import shared
from .retrieval import check_sizes, counted, ranked

TILE = 1024  # texts of a tile, about
BUCKETS = 64  # of terms
PART = 4096  # tiles whose rows of a bucket are in one file
ENTRIES = 500_000  # terms of queries that are searched in one pass
_POSTINGS = "term long, tile long, id long, weight double, bucket int, part int"
_TERMS = "term long, idf double, bucket int"


def _bucket(buckets: int):
    return F.pmod(F.col("term"), F.lit(buckets)).cast("int").alias("bucket")


def build_index(spark: SparkSession, docs: DataFrame, path: str, tile: int = TILE, buckets: int = BUCKETS) -> None:
    """docs(id, text) -> an index under `path`, which must be a new folder; ready once its manifest is there.

    Weights are (1 + ln count) * idf with idf = ln((1 + n) / (1 + df)) + 1, over the length of the text's vector. Rows
    that repeat an id are one text; rows without an id are left out, and null texts are empty. Terms are 64-bit hashes.
    Rows of a common term are spread over parts by tile. If a writer dies, the folder has no manifest, and the next one
    writes its files anew.
    """
    rows = docs.select(F.col("id").cast("long").alias("id"), "text").where("id IS NOT NULL")
    every, n = rows.agg(F.count("*"), F.countDistinct("id")).first()
    tiles = max(1, -(-n // tile))
    counts = counted(rows, "id")
    if every > n:
        counts = counts.groupBy("id", "term").agg(F.sum("c").alias("c"))
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    idf = (F.ln((1 + F.lit(float(n))) / (1 + F.count("*"))) + 1).alias("idf")
    terms = counts.groupBy("term").agg(idf).select("term", "idf", _bucket(buckets))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    idfs = spark.read.schema(_TERMS).parquet(f"{path}/terms").select("term", "idf")
    weighed = counts.join(idfs, "term").select("id", "term", ((1 + F.ln("c")) * F.col("idf")).alias("w"))
    unit = F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))  # of a text's own terms
    place = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("long")
    each = weighed.select("term", place.alias("tile"), "id", unit.alias("weight"), _bucket(buckets), F.floor(place / PART).cast("int").alias("part"))
    each.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "term", "tile").write.mode("overwrite").partitionBy("bucket", "part").parquet(f"{path}/postings")
    shared.delete(spark, f"{path}/counts")
    shared.publish(spark, f"{path}/manifest.json", json.dumps({"texts": n, "tiles": tiles, "buckets": buckets}))


def stored_index(spark: SparkSession, docs: DataFrame, tile: int = TILE, buckets: int = BUCKETS) -> str:
    """The path of the index of docs(id, text) in the shared folder, built where there is none for the files they read
    as they now are."""
    path = f"{shared.shared_dir(spark)}/lexical-{shared.input_digest(spark, docs, tile, buckets)}"
    if not shared.exists(spark, f"{path}/manifest.json"):
        build_index(spark, docs, path, tile, buckets)
    return path


def _questions(spark: SparkSession, path: str, queries: DataFrame, buckets: int) -> DataFrame:
    """queries(query_id, text) -> query_id, entries of (term, weight): unit vectors of the terms that the index has."""
    said = counted(queries, "query_id").select("query_id", "term", "c", _bucket(buckets))
    known = spark.read.schema(_TERMS).parquet(f"{path}/terms")
    weighed = said.join(known, ["bucket", "term"]).select("query_id", F.struct("term", ((1 + F.ln("c")) * F.col("idf")).alias("w"), "idf").alias("x"))
    entries = weighed.groupBy("query_id").agg(F.collect_list("x").alias("x"))  # a query's own terms bound this list
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return entries.select("query_id", F.transform("x", lambda x: F.struct(x["term"].alias("term"), (x["w"] / length).alias("w"))).alias("entries"))


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """queries(query_id, text) -> query_id, rank, id, score: the k texts of the index with the largest cosine above 0,
    to nine places, ties to smaller ids. Queries without known terms have no rows; ids of queries are unique.

    Queries are searched in sets of bounded size, each with one pass over the rows of its terms.
    """
    check_sizes(k)
    buckets = json.loads(shared.read_text(spark, f"{path}/manifest.json"))["buckets"]
    asked = _questions(spark, path, queries, buckets)
    sizes = asked.agg(F.sum(F.size("entries"))).first()[0] or 0 if queries.count() > ENTRIES // 1000 else 0
    sets, found = max(1, -(-sizes // ENTRIES)), None
    for i in range(sets):
        some = (asked if sets == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(sets)) == i)).collect()
        terms = sorted({e["term"] for r in some for e in r["entries"]})
        wanted = spark.createDataFrame([(t,) for t in terms], "term long")
        rows = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").where(F.col("bucket").isin(sorted({t % buckets for t in terms})))
        rows = rows.join(F.broadcast(wanted), "term", "left_semi").select("tile", "term", "id", "weight")  # ENTRIES terms at most
        given = spark.sparkContext.broadcast([(r["query_id"], [e["term"] for e in r["entries"]], [e["w"] for e in r["entries"]]) for r in some])
        best = rows.repartition("tile").sortWithinPartitions("tile", "term").mapInArrow(_through_tiles(given, k), "query_id long, id long, score double")
        found = best if found is None else found.unionByName(best)
    return ranked(found, k)


def _through_tiles(given, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for rows in _by_tile(batches):
            _search_tile(rows, given.value, best, k)
        ids, scores = ([x[i] for x in best.values()] for i in (0, 1))
        asked = np.repeat(np.array(list(best), np.int64), [len(x) for x in ids])
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(flat(ids, np.int64)), pa.array(flat(scores, float))], ["query_id", "id", "score"])

    return run


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, tuple]]:
    """The rows of one tile after the other: term -> ids, weights, the largest weight."""
    held: list[list[np.ndarray]] = []  # of the last tile that was seen, which may go on
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        cuts = np.flatnonzero(np.diff(columns[0])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if held and a < b and held[-1][0][0] != columns[0][a]:
                yield _by_term(held)
                held = []
            if a < b:
                held.append([c[a:b] for c in columns])
    if held:
        yield _by_term(held)


def _by_term(parts: list[list[np.ndarray]]) -> dict[int, tuple]:
    _, terms, ids, weights = (np.concatenate(c) for c in zip(*parts))
    cuts = (np.flatnonzero(np.diff(terms)) + 1).tolist()
    begin = [0, *cuts]
    most = np.maximum.reduceat(weights, begin)
    return {t: (ids[a:b], weights[a:b], m) for t, a, b, m in zip(terms[begin].tolist(), begin, [*cuts, len(terms)], most.tolist())}


def _search_tile(rows: dict[int, tuple], queries: list[tuple], best: dict[int, tuple], k: int) -> int:
    """Takes the tile's scores into the k best (ids, scores) of each query; returns how many queries it was scored for."""
    names, place = np.unique(np.concatenate([r[0] for r in rows.values()]), return_inverse=True)
    at, begin = {}, 0
    for term, (ids, _, _) in rows.items():
        at[term] = place[begin : begin + len(ids)]
        begin += len(ids)
    scored = 0
    for query_id, terms, weights in queries:
        here = [(t, w) for t, w in zip(terms, weights) if t in rows]
        kth = best[query_id][1][-1] if query_id in best and len(best[query_id][1]) == k else 0.0
        if not here or sum(w * rows[t][2] for t, w in here) < kth - 1e-8:
            continue
        scored += 1
        sums = np.zeros(len(names))
        for t, w in here:
            sums[at[t]] += w * rows[t][1]
        sums = np.round(sums, 9)
        hit = np.flatnonzero((sums > 0) & (sums >= kth))
        if len(hit) > k:
            hit = hit[sums[hit] >= np.partition(sums[hit], len(hit) - k)[len(hit) - k]]
        ids, scores = names[hit], sums[hit]
        if query_id in best:
            ids, scores = np.concatenate([best[query_id][0], ids]), np.concatenate([best[query_id][1], scores])
        order = np.lexsort((ids, -scores))[:k]
        if len(order):
            best[query_id] = ids[order], scores[order]
    return scored
