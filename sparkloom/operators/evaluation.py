"""Retrieval evaluation: recall, reciprocal rank, NDCG, coverage, method choice, classifier metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_query(judged: DataFrame, by: Sequence[str], cut: int = 5) -> DataFrame:
    """judged(by..., rank, relevant) -> first relevant rank and NDCG at the cut; the ideal order is of the list itself."""
    gain = F.when(F.col("relevant") & (F.col("rank") <= cut), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    found = F.count_if(F.col("relevant") & (F.col("rank") <= cut))
    rows = judged.groupBy(*by).agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"), F.sum(gain).alias("dcg"), found.alias("found"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("found", F.lit(1))), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    return rows.withColumn("ndcg", F.when(F.col("found") > 0, F.col("dcg") / ideal).otherwise(0.0)).drop("dcg", "found")


def summary(cases: DataFrame, by: Sequence[str], cut: int = 5) -> DataFrame:
    """cases(first_rank, ndcg) -> number of cases, recall at 1, 3 and 5, mean reciprocal rank and NDCG at the cut, failures."""
    hit = lambda k: F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 6)
    mrr = F.avg(F.when(F.col("first_rank") <= cut, 1 / F.col("first_rank")).otherwise(0.0))
    return cases.groupBy(*by).agg(
        F.count("*").alias("cases"), hit(1).alias("recall_1"), hit(3).alias("recall_3"), hit(5).alias("recall_5"),
        F.round(mrr, 6).alias("mrr_5"), F.round(F.avg("ndcg"), 6).alias("ndcg_5"), F.count_if(F.col("first_rank").isNull() | (F.col("first_rank") > cut)).alias("failures"),
    )


def relevant(doc: Column, page: Column, section: Column, text: Column, docs: Column, pages: Column, sections: Column, words: Column) -> Column:
    """An accepted document and any of: an expected page, an expected section (contained either way), a keyword.
    Cases without such labels need the document only."""
    low = F.lower(F.coalesce(section, F.lit("")))
    labelled = (F.size(pages) > 0) | (F.size(sections) > 0) | (F.size(words) > 0)
    by_section = (low != "") & F.exists(sections, lambda s: low.contains(F.lower(s)) | F.lower(s).contains(low))
    return F.array_contains(docs, doc) & (~labelled | F.array_contains(pages, page) | by_section | F.exists(words, lambda w: F.lower(text).contains(F.lower(w))))


def grounded(page: Column, section: Column, text: Column, pages: Column, sections: Column, words: Column) -> Column:
    """By the first kind of label that a case has: pages, else sections, else keywords; null without labels."""
    return (
        F.when(F.size(pages) > 0, F.array_contains(pages, page)).when(F.size(sections) > 0, F.exists(sections, lambda s: F.lower(section).contains(F.lower(s))))
        .when(F.size(words) > 0, F.exists(words, lambda w: F.lower(text).contains(F.lower(w))))
    )


def coverage(found: Column, expected: Column) -> Column:
    """Share of expected ids among found ones; null if none is expected."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, found)) / F.size(F.array_distinct(expected)))


def precision(found: Column, expected: Column) -> Column:
    return F.when((F.size(expected) > 0) & (F.size(found) > 0), F.size(F.filter(found, lambda x: F.array_contains(expected, x))) / F.size(found))


def lock_score(section: Column, ids: Column, covered: Column, recall: Column) -> Column:
    return 0.25 * section + 0.05 * ids + 0.35 * covered + 0.35 * recall


def chosen_method(methods: DataFrame) -> DataFrame:
    """Methods (method, floor, recall_5, mrr_5, recall_1, latency) in the order of choice; a handful of rows."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("floor"), F.desc("recall_5"), F.desc("mrr_5"), F.desc("recall_1"), "latency", "method")
    return methods.withColumn("place", F.row_number().over(order))


def rank_pivot(cases: DataFrame, case: str, methods: Sequence[str]) -> DataFrame:
    """(case, method, first_rank) -> a column for each method, and how the second compares with the first."""
    wide = cases.groupBy(case).pivot("method", list(methods)).agg(F.min("first_rank"))
    a, b = (F.coalesce(F.col(m), F.lit(1 << 30)) for m in methods[:2])
    return wide.withColumn("compared", F.when(b < a, "better").when(b > a, "worse").otherwise("tied"))


def classifier_metrics(predictions: DataFrame) -> DataFrame:
    """(label, predicted) -> one row: rows, accuracy, macro F1 over the labels that occur."""
    cells = predictions.groupBy("label", "predicted").count()  # a row for each pair of classes
    per = (
        cells.select(F.col("label").alias("c"), F.when(F.col("label") == F.col("predicted"), F.col("count")).otherwise(0).alias("tp"), F.col("count").alias("true"), F.lit(0).cast("long").alias("said"))
        .unionByName(cells.select(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("true"), F.col("count").alias("said")))
        .groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("true").alias("true"), F.sum("said").alias("said"))
    )
    return per.agg(F.sum("true").alias("n"), F.round(F.sum("tp") / F.sum("true"), 6).alias("accuracy"), F.round(F.avg(2 * F.col("tp") / (F.col("true") + F.col("said"))), 6).alias("macro_f1"))


def chunk_checks(chunks: DataFrame, by: str, most: int) -> DataFrame:
    """Per strategy: whether texts hold something, ids are unique, pages start at 1, and no chunk is longer than `most`."""
    return chunks.groupBy(by).agg(
        F.bool_and(F.trim("text") != "").alias("nonempty_text"), (F.countDistinct("chunk_id") == F.count("*")).alias("unique_chunk_ids"),
        F.bool_and(F.col("page_number") >= 1).alias("valid_page_numbers"), F.bool_and(F.col("character_count") <= most).alias("size_limit_respected"),
    )


def generation_report(judged: DataFrame) -> DataFrame:
    """Cases, routing accuracy and mean marks of all answers and of those that were to be text, visual, or cross-language;
    marks that are null count in no mean."""
    groups = F.array_compact(F.array(F.lit("Overall"), F.when(F.col("mode") == "text", "Text"), F.when(F.col("mode") == "visual", "Visual"), F.when(F.col("cross_language"), "Cross-language")))
    mean = lambda c, n: F.round(F.avg(F.col(c).cast("double")), 6).alias(n)
    return judged.withColumn("evaluated", F.explode(groups)).groupBy("evaluated").agg(
        F.count("*").alias("cases"), mean("router_ok", "routing_accuracy"), mean("faithful", "faithfulness"), mean("correct", "correctness"), mean("relevant", "relevance"), mean("same_doc", "same_doc_rate"), mean("no_images", "text_no_images_rate")
    )


def weighted_mean(rows: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Mean of the values that are there, not NaN, by weight; and the plain mean."""
    v = F.when(~F.isnan(value), F.col(value))
    w = F.when(v.isNotNull(), F.col(weight))
    return rows.groupBy(*by).agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.sum(v * w) / F.nullif(F.sum(w), F.lit(0)), 6).alias("weighted"))
