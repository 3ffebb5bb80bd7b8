"""Vector index tables: ids, manifests, upsert with removal of stale rows, resumable work."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMESPACE = uuid.UUID("6f0c1f1e-8a53-4b8e-9c55-0d3f1f5b7a21")


def document_id(stem: Column, path: Column) -> Column:
    return F.concat(stem, F.lit("-"), F.substring(F.sha2(F.lower(path), 256), 1, 12))


def point_id(chunk_id: Column) -> Column:
    """A version-5 UUID of a chunk's id: the SHA-1 of the namespace and the name, with the version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(chunk_id, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12)
    )


def fingerprint(rows: DataFrame, id_col: str, text_col: str, buckets: int = 1024) -> DataFrame:
    """(rows, fingerprint) of a set of texts by id, whatever the order of rows; hashes are combined bucket by bucket,
    so no task gathers all of them."""
    each = rows.select(F.sha2(F.concat(F.col(id_col).cast("string"), F.lit("\0"), F.col(text_col), F.lit("\0")), 256).alias("h"))
    part = each.groupBy(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("b")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"), F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")).alias("s"))
    return part.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "n", "x", "s"))), lambda r: F.concat_ws(":", r["b"], r["n"], r["x"], r["s"])), ","), 256).alias("fingerprint"))


def synced(existing: DataFrame, new: DataFrame, key: str, source: str) -> DataFrame:
    """The index after new rows of some sources came: rows of those sources that are not among the new ones are gone."""
    sources = new.select(source).distinct()
    kept = existing.join(sources, source, "left_anti").select(existing.columns)
    return kept.unionByName(new.dropDuplicates([key]).select(existing.columns))


def stale(existing: DataFrame, new: DataFrame, key: str, source: str) -> DataFrame:
    return existing.join(new.select(source).distinct(), source, "left_semi").join(new.select(key), key, "left_anti")


def todo(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose keys (a content hash and options) are not among finished ones, each once."""
    return items.dropDuplicates(keys).join(done.select(*keys).distinct(), keys, "left_anti")
