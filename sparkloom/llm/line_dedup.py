"""Cross-site line dedup: HyperLogLog sketches of the sites of each line, exact counts near the threshold.

Lines are compared by a 64-bit hash of the line without surrounding white space, sites by one of their name. A line that only one site
has needs no sketch; for the rest, sketches are built in salted parts and merged. Estimates below or above the
uncertain band decide at once; lines within it get exact distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables

MIN_SITES = 5
LG_K = 12
BAND = 0.1  # six standard errors of a sketch with 2^12 registers (1.04 / 2^6 each)
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _hash(line: Column) -> Column:
    return F.xxhash64(_trim(line))


def _of(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows whose line is among the lines; rows of a common line are dealt out by their salt too."""
    salted = lines.select("line", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))).alias("salt"))
    return rows.join(salted, ["line", "salt"], "left_semi")


def boilerplate(documents: DataFrame, text: str, site: str, min_sites: int = MIN_SITES) -> DataFrame:
    """The hashes (line) of lines with words that occur on min_sites distinct non-null sites or more."""
    salt = F.pmod(F.xxhash64("doc_id", site), F.lit(SALTS)).alias("salt")
    # numbers only: their least and most are found while hashing, where strings would have every line sorted
    hashed = F.xxhash64(F.col(site).cast("string")).alias("site")
    lines = documents.where(F.col(site).isNotNull()).select(hashed, salt, F.explode(_lines(F.col(text))).alias("line")).where(_trim(F.col("line")) != "").select(_hash(F.col("line")).alias("line"), "site", "salt")
    sites = lines.groupBy("line").agg(F.min("site").alias("least"), F.max("site").alias("most"))
    if min_sites < 2:
        return sites.select("line")
    shared = _of(lines, sites.where("least != most"))
    sketches = (
        shared.groupBy("line", "salt").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
        .groupBy("line").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sites"))
    )
    near = (F.col("sites") >= min_sites * (1 - BAND) - 1) & (F.col("sites") <= min_sites * (1 + BAND) + 1)
    # distinct pairs are made before rows meet by line
    exact = (
        _of(lines, sketches.where(near)).select("line", "site").distinct()
        .groupBy("line").count().where(F.col("count") >= min_sites).select("line")
    )
    return sketches.where(~near & (F.col("sites") >= min_sites)).select("line").unionByName(exact)


def line_dedup(spark: SparkSession, documents: DataFrame, min_sites: int = MIN_SITES, max_share: float | None = None, site: str = "source") -> DataFrame:
    """documents(doc_id, text, site) -> doc_id, n_lines, n_removed, clean_text: one row for each input row.

    Lines are split at line feeds. Lines that occur on `min_sites` distinct sites or more are removed, whatever
    their share of a document; only a document with no other lines with words stays whole: it is itself a
    widespread text, for near-duplicate removal. With a `max_share`, documents of which they are more than that
    share of the characters without line feeds stay whole instead. Lines without words are never removed. A null
    site gives no evidence, a null text has no lines and stays null. Rows that repeat a doc_id and text are
    treated alike. Other columns are not read. An empty table gives an empty result.
    """
    return _cleaned(spark, documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(site).cast("string").alias("site")), min_sites, max_share).select("doc_id", "n_lines", "n_removed", "clean_text")


def lines_cut(spark: SparkSession, documents: DataFrame, min_sites: int = MIN_SITES, max_share: float | None = None, site: str = "source") -> DataFrame:
    """documents with those lines cut out of text, and n_chars to match where there is one; all columns stay.

    Nulls, empty texts, empty tables and rows that repeat are treated as line_dedup() does; no row goes.
    """
    rows = documents.select("doc_id", "text", F.col(site).cast("string").alias("site"), F.struct(*documents.columns).alias("row"))
    cut = _cleaned(spark, rows, min_sites, max_share)
    new = {"text": F.col("clean_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("clean_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in documents.columns else None}
    return cut.select(*(new.get(c, F.col("row")[c]).alias(c) for c in documents.columns))


def _cleaned(spark: SparkSession, docs: DataFrame, min_sites: int, max_share: float | None) -> DataFrame:
    tables = Tables(spark)
    found = tables.keep(boilerplate(docs, "text", "site", min_sites), "boilerplate")
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).alias("salt")
    lines = docs.select("doc_id", F.xxhash64("text").alias("key"), salt, F.explode(_lines(F.col("text"))).alias("line")).select("doc_id", "key", "salt", _hash(F.col("line")).alias("line"))
    # a document's own lines bound this list
    removed = tables.keep(_of(lines, found).groupBy("doc_id", "key").agg(F.collect_set("line").alias("removed")), "removed")
    joined = docs.withColumn("key", F.xxhash64("text")).join(
        removed.withColumnsRenamed({"doc_id": "r_doc_id", "key": "r_key"}), F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("key") == F.col("r_key")), "left"
    )
    kept = F.filter(_lines(F.col("text")), lambda x: (_trim(x) == "") | ~F.array_contains(F.col("removed"), _hash(x)))
    cut = (
        joined.withColumn("kept", F.when(F.col("removed").isNotNull(), kept))
        .withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(_lines(F.col("text")))).cast("long"))
        .withColumn("chars", F.length(F.replace("text", F.lit("\n"), F.lit(""))))
        .withColumn("stays", F.length(F.array_join("kept", "")))
    )
    allowed = F.exists("kept", lambda x: _trim(x) != "") if max_share is None else (F.col("chars") - F.col("stays")) <= max_share * F.col("chars")
    is_cut = F.col("kept").isNotNull() & allowed
    return (
        cut.withColumn("n_removed", F.when(is_cut, F.col("n_lines") - F.size("kept")).otherwise(0).cast("long"))
        .withColumn("clean_text", F.when(is_cut, F.array_join("kept", "\n")).otherwise(F.col("text")))
        .drop("key", "r_key", "r_doc_id", "removed", "kept", "chars", "stays")
    )
