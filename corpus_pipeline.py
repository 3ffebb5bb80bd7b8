"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes the documents that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Tables, table
from sparkloom.llm.decontaminate import decontaminated
from sparkloom.llm.line_dedup import lines_cut
from sparkloom.llm.minhash import near_duplicates
from sparkloom.llm.packing import packed
from sparkloom.llm.quality import quality_kept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents scored below its threshold go. Null and empty texts are scored as texts without words;
    rows that repeat are scored each; without labels, or of an empty table, nothing goes."""
    return quality_kept(spark, docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: lines that many sites share are cut out of all documents that have others. No row goes; null and
    empty texts stay as they are, and a null source gives no evidence."""
    return lines_cut(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1, five words and similarity 0.8: exactly one row of each group stays.

    Rows are linked by their texts alone: those that repeat a doc_id, or have none, are rows like others. Of a
    group, the row with the smallest doc_id stays, and one with a null only if all are null. Rows without words
    are linked with nothing and all stay.
    """
    # the columns of documents go in one, so that none of theirs is taken for one of these
    numbered = Tables(spark).keep(docs.select(F.monotonically_increasing_id().alias("near_row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "rows")
    found = near_duplicates(spark, numbered.select(F.col("near_row").alias("doc_id"), F.col("row.text").alias("text")), k=5, num=80, den=100)
    groups = found.select(F.col("doc_id").alias("near_row"), "component_id").join(numbered.select("near_row", F.col("row.doc_id").alias("doc_id")), "near_row")
    stays = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "near_row"))["near_row"].alias("near_row"))
    return numbered.join(stays.select("near_row"), "near_row", "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: words inside windows of benchmark items are cut out; documents mostly made of them go. Null and
    empty texts stay, and with an empty benchmark everything does."""
    return decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: sequences of 2048 tokens; a null or empty text is one token, rows that repeat are packed each."""
    return packed(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("minhash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]

ORACLE_SQL = None  # classifier, near-dedup and packing have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and reread. A stage's table goes
    once the next one is written; the last one's stays, for the packing reads it."""
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = tables.keep(docs, f"stage-{i}")
            tables.drop(f"stage-{i - 1}")
    return docs
