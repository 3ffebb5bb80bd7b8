"""Token counts through a digest cache: known contents are joined, only distinct misses are encoded and appended."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, among, text_or_empty
from .tokens import ByteCounts, digest, loaded

_CACHE = "tokenizer string, digest binary, n_tokens long"


def _encode(path: str, version: str):
    def run(batches):
        tokenizer = loaded(ByteCounts, path)
        for batch in batches:
            n = tokenizer.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), batch.column(0), pa.array(n, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    return run


def token_counts(spark: SparkSession, documents: DataFrame, vocabulary: str, cache: str, limit: int = 512) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit: one row for each input row.

    `vocabulary` is the path of a byte-level vocabulary of the tokenizers library, which every executor can
    read; `cache` is a folder of Parquet in a shared store, keyed by SHA-256 of the text (this kind of
    vocabulary normalises nothing) and of the vocabulary's file. Digests are looked up first; only texts that are
    not in the cache are moved, and each distinct one is encoded once. A digest that is stored twice, as after
    two runs at a time, counts once. Null and empty texts count as empty: no tokens. Rows that repeat a text are
    encoded once; an empty table gives an empty result. Other columns are not read.
    """
    version = digest(vocabulary)
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    try:
        known = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException:  # nothing stored yet
        known = spark.createDataFrame([], _CACHE)
    known = known.where(F.col("tokenizer") == version).select("digest").distinct()
    tables = Tables(spark)
    new = tables.keep(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "misses")
    some = keyed.where(among(spark, new.select(F.xxhash64("digest")), F.xxhash64("digest")))
    misses = some.groupBy("digest").agg(F.min("text").alias("text")).join(new, "digest", "left_semi")
    misses.mapInArrow(_encode(vocabulary, version), _CACHE).write.mode("append").parquet(cache)
    tables.drop("misses")
    # written, so that the join below can be split where a digest is common
    stored = spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = tables.keep(stored, "counts")
    return (
        keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
