"""Thin queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitslice import search
from .common import Tables, table
from .decontaminate import matches
from .line_dedup import line_dedup
from .merkle import manifest
from .minhash import near_duplicates
from .nearest import nearest
from .packing import packed
from .preference import preference_pairs, swapped_answers
from .quality import quality_scores
from .secret_scan import BASE, joined, secret_spans
from .token_counts import token_counts
from .toxicity import toxicity
from .winnow import fingerprints


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark, table(spark, sf_dir, "documents"))


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_pairs(swapped_answers(table(spark, sf_dir, "conversations")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels marks one kind of toxicity; the chain predicts low quality first and feeds it to the model of toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity(spark, table(spark, sf_dir, "documents"), labels, ("low_quality", "toxic"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own, that goes when the driver ends: each call encodes all distinct texts."""
    cache = f"{Tables(spark).root}/token-counts"
    return token_counts(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind, *_ in BASE]
    base = F.filter("spans", lambda x: x["nth"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_minhash, op2_line_dedup, op3_preference, op4_quality, op5_toxicity, op6_decontamination, op7_token_counts, op8_secrets, op9_nearest, op10_packing, op11_search, op12_merkle, op13_fingerprints)
}
