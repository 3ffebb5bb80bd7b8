"""Merkle manifest of a dataset: a trie over exact ranks in each source, proofs for every row, checks of changed rows.

Rows get their rank within a source from histograms of doc_id digits. Digits of the rank in base FANOUT are the keys
of the trie: nodes that share all digits but the last are the children of one node, so the trie is reduced prefix by
prefix, two digits to a shuffle. On the way down each node hands its children the siblings that a proof needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables
from .ranks import DIGIT, digits, ranked

FANOUT = 16
BLOCK = FANOUT * FANOUT  # ranks that are reduced in one go
PART = 4096  # copies of one row that are made at a time
CROWD = 64 << DIGIT  # different rows under one id prefix that a window may hold
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left: string, right: string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(_field(F.col(c)) for c in FIELDS[:-1]), _field(text)), 256)


def tampered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def manifest(spark: SparkSession, documents: DataFrame, changed: Column | None = None, text: Column | None = None) -> DataFrame:
    """documents(doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified:
    one row for each input row.

    `changed` picks rows whose text is checked as `text` (by default those whose id's CRC-32 five divides, with small
    letters): their leaf is made anew and folded with the siblings of the original, so `verified` says whether the
    manifest noticed nothing. Where `changed` is null, a row is unchanged. A null doc_id comes before all others of its
    source and a null source before all others; rows of a source that repeat a doc_id ascend by leaf, and rows that
    are equal in all five columns get places side by side. An empty table gives an empty result. Other columns are not
    read.
    """
    tables = Tables(spark)
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0 if changed is None else changed
    leaf, new = _leaf(F.col("text")), tampered(F.col("text")) if text is None else text
    # '' for a null source, which so comes first in order, and '=' before all others
    rows = documents.select(*(F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS)).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("grp"), F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"),
        leaf.alias("leaf"), F.when(changed & F.col("text").isNotNull(), _leaf(new)).alias("other"),
    )
    distinct = tables.keep(rows.groupBy("grp", "has_id", "id", "leaf", "other").agg(F.count("*").alias("n")), "leaves")
    placed = _placed(distinct)
    copies = placed.select("*", F.explode(F.expr(f"sequence(0L, n - 1, {PART}L)")).alias("part")).select(
        "grp", F.struct(F.when(F.col("has_id"), F.col("id")).alias("doc_id"), F.coalesce("other", "leaf").alias("checked")).alias("row"), "leaf",
        F.explode(F.expr(f"sequence(before + part, before + least(part + {PART - 1}, n - 1))")).alias("rank"),
    )
    rounds = _reduced(tables, copies.select("grp", "rank", F.struct(F.col("leaf").alias("hash"), "row").alias("node")), "trie")
    subroots = tables.keep(rounds[-1].select("grp", F.col("up").alias("subroot")), "subroots")
    top = _reduced(tables, _in_order(tables, subroots).select(F.lit("").alias("grp"), "rank", F.struct(F.col("subroot").alias("hash"), F.col("grp").alias("row")).alias("node")), "top")
    paths = top[-1].select("grp", "block", F.expr(f"cast(array() as {_PATH})").alias("path"), F.col("up").alias("root"), F.lit(None).cast("string").alias("subroot"))
    for blocks in reversed(top):
        paths = _handed_down(blocks, paths)
    paths = tables.keep(paths.select(F.col("node.row").alias("grp"), F.lit(0).cast("long").alias("block"), "path", "root", F.col("node.hash").alias("subroot")), "paths")
    for blocks in reversed(rounds):
        paths = _handed_down(blocks, paths)
    folded = F.aggregate("path", F.col("node.row.checked"), lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))
    proof = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    return paths.select(
        F.col("node.row.doc_id").alias("doc_id"), F.col("node.hash").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _placed(rows: DataFrame) -> DataFrame:
    """rows(grp, has_id, id, leaf, n) with `before`, the rank of the first of n equal rows in its source."""
    bounds = rows.where("has_id").agg(F.min("id"), F.max("id")).first()
    prefixes = digits(F.col("id"), *bounds, "id")
    rows, path = rows.withColumns(prefixes), ["has_id", *prefixes]
    crowd = rows.groupBy("grp", *path).count().agg(F.max("count")).first()[0]
    if (crowd or 0) <= CROWD:
        return ranked(rows, ["grp"], [*path, "id"], ["id", "leaf"])
    bits = {f"leaf_{n}": F.substring("leaf", 1, n) for n in (2, 4, 6)}  # an id with very many texts
    return ranked(rows.withColumns(bits), ["grp"], [*path, "id", *bits, "leaf"])


def _in_order(tables: Tables, subroots: DataFrame) -> DataFrame:
    """subroots(grp, subroot) with the rank of grp: counts of key ranges, then the rank within a range."""
    dealt = tables.keep(subroots.repartitionByRange("grp").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("grp"))
    return dealt.join(before.select("part", "before"), "part").withColumn("rank", (F.col("before") + nth - 1).cast("long"))


def _hashed(nodes: Column) -> Column:
    """The parents' hashes of an array of hashes in order."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / FANOUT).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT)), ""), 256))


def _reduced(tables: Tables, nodes: DataFrame, name: str) -> list[DataFrame]:
    """nodes(grp, rank, node) -> tables of blocks(grp, block, nodes, runs, up, alone), from the leaves to one block a group.

    `runs` are the hashes of the block's runs and `up` the hash of these. A block that is alone in its group stops
    where one hash is left.
    """
    rounds: list[DataFrame] = []
    while True:
        blocks = nodes.groupBy("grp", F.floor(F.col("rank") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", "node"))).alias("nodes"))
        blocks = tables.keep(blocks.select("grp", "block", F.transform("nodes", lambda x: x["node"]).alias("nodes")), f"{name}-nodes-{len(rounds)}")
        last = blocks.groupBy("grp").agg(F.max("block").alias("last"))
        hashes = F.transform("nodes", lambda x: x["hash"])
        one = lambda c: F.col("alone") & (F.size(c) == 1)
        blocks = (
            blocks.join(last, "grp").withColumn("alone", F.col("last") == 0).drop("last")
            .withColumn("runs", F.when(one("nodes"), hashes).otherwise(_hashed(hashes)))
            .withColumn("up", F.when(one("runs"), F.col("runs")[0]).otherwise(_hashed(F.col("runs"))[0]))
        )
        blocks = tables.keep(blocks, f"{name}-{len(rounds)}")
        tables.drop(f"{name}-nodes-{len(rounds)}")
        rounds.append(blocks)
        if blocks.where("NOT alone").isEmpty():
            return rounds
        nodes = blocks.select("grp", F.col("block").alias("rank"), F.struct(F.col("up").alias("hash"), F.lit(None).cast("string").alias("row")).alias("node"))


def _step(of: Column, i: Column, applies: Column) -> Column:
    """The path's step at place i of a run of hashes: none where the level is not there."""
    own = F.struct(F.array_join(F.slice(of, F.lit(1), i), "").alias("left"), F.array_join(F.slice(of, i + 2, F.lit(FANOUT)), "").alias("right"))
    return F.when(applies, F.array(own)).otherwise(F.expr(f"cast(array() as {_PATH})"))


def _handed_down(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """paths(grp, block, path, root, subroot) of blocks -> the same of their nodes, with block as the node's rank."""
    runs = blocks.join(paths, ["grp", "block"]).select("*", F.posexplode("runs").alias("i", "run")).select(
        "grp", F.col("block") * FANOUT + F.col("i"), F.slice("nodes", F.col("i") * FANOUT + 1, F.lit(FANOUT)).alias("nodes"),
        F.concat(_step(F.col("runs"), F.col("i"), ~(F.col("alone") & (F.size("runs") == 1))), "path").alias("path"),
        (~(F.col("alone") & (F.size("nodes") == 1))).alias("hashed"), "root", "subroot",
    ).toDF("grp", "run", "nodes", "path", "hashed", "root", "subroot")
    return runs.select("*", F.posexplode("nodes").alias("i", "node")).select(
        "grp", (F.col("run") * FANOUT + F.col("i")).alias("block"),
        F.concat(_step(F.transform("nodes", lambda x: x["hash"]), F.col("i"), F.col("hashed")), "path").alias("path"), "root", "subroot", "node",
    )
