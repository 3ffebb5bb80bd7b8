"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(tables: Tables, links: DataFrame, name: str = "components") -> DataFrame:
    """links(a, b): undirected, ids of a type with an order. Returns (id, component): the smallest id reachable.

    Every id that occurs in a link of two different ids has one row; nulls and self-links are left out.
    Each round is two joins and three aggregations over the current links and is written to the shared
    folder; rounds stop when the link table no longer changes. An empty link table gives an empty result.
    """
    edges = tables.keep(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("u") > F.col("v"))
        .distinct(),
        f"{name}-0",
    )
    before, n = None, 0
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before or now[0] == 0:
            break
        before, n = now, n + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = tables.keep(small, f"{name}-{n}")
        tables.drop(f"{name}-{n - 1}")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
