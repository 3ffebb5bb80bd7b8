"""Answers put together from search results: brief contexts, image texts, linked chunks, cards, topics, intents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import linked_chunks
from .retrieval import check_sizes, dense_topk, gated_search, keyword_intent


def _line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def _unique(texts: Column) -> Column:
    """Texts on one line each, blanks and repeats left out."""
    return F.array_distinct(F.filter(F.transform(texts, _line), lambda t: t != ""))


def joined_texts(texts: Column, most: int) -> Column:
    """Unique texts with an empty line between, up to the first that would pass `most` characters."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(acc: Column, t: Column) -> Column:
        longer = F.when(acc["text"] == "", t).otherwise(F.concat(acc["text"], F.lit("\n\n"), t))
        full = acc["full"] | (F.length(longer) > most)
        return F.struct(F.when(full, acc["text"]).otherwise(longer).alias("text"), full.alias("full"))

    return F.aggregate(_unique(texts), start, add, lambda acc: acc["text"])


def brief_context(texts: Column, most: int) -> Column:
    """Unique texts on one line, cut to `most` characters at the last end of a sentence if that leaves max(40, most / 3)
    at least, else at the last blank, else to the first texts that fit whole."""
    whole = F.array_join(_unique(texts), " ")
    window = F.substring(whole, 1, most)
    # what follows the window tells whether its last character ends a sentence
    sentence = F.regexp_extract(F.concat(window, F.substring(whole, most + 1, 1)), r"(?s)^(.*[.!?](?:[\"')\]]+)?)(?=\s|$)", 1)
    sentence = F.when(F.length(sentence) <= most, sentence).otherwise(F.regexp_extract(window, r"(?s)^(.*[.!?](?:[\"')\]]+)?)(?=\s)", 1))
    at_word = F.regexp_extract(window, r"(?s)^(.*\S)\s", 1)
    return F.when(F.length(whole) <= most, whole).when(F.length(sentence) >= max(40, most // 3), F.trim(sentence)).when(at_word != "", at_word).otherwise(joined_texts(texts, most))


def stage_texts(document: Column, heading: Column, nearby: Column, visual: Column) -> Column:
    """struct(stage1, source1, stage2, source2) of an image: its heading leads, else what is nearby, else what is seen;
    null where it has none of them. The labels are fixed texts."""
    document, heading, nearby, visual = (_line(c) for c in (document, heading, nearby, visual))
    labelled = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c))
    lines = lambda *cs: F.concat_ws("\n", *cs)
    doc = F.when(document != "", F.concat(F.lit("Document: "), document))
    description, seen = labelled("Description", nearby), labelled("Visual description", visual)
    made = lambda one, source, two, source2: F.struct(lines(doc, one).alias("stage1"), F.lit(source).alias("source1"), two.alias("stage2"), F.when(two == "", "none").otherwise(source2).alias("source2"))
    return (
        F.when(heading != "", made(labelled("Topic", heading), "heading", lines(description, seen), "nearby_vlm"))
        .when(nearby != "", made(description, "nearby", lines(seen), "vlm")).when(visual != "", made(seen, "vlm", F.lit(""), "none"))
    )


def extraction_method(usable: Column, two_columns: Column) -> Column:
    """ocr where the text of the file is not usable, else by layout where a region has two columns, else as it is."""
    return F.when(~F.coalesce(usable, F.lit(False)), "ocr").when(two_columns, "native_layout_aware").otherwise("native")


def display_cards(contexts: DataFrame, chunks: DataFrame, base: str, n: int = 5) -> DataFrame:
    """Cards of the first n images of each query: the texts they link, else what is nearby, in order of rank."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    first = lambda *cs: strip(F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cs), F.lit("")))
    few = contexts.where(F.col("rank") <= n)
    links = few.select("query_id", "rank", F.posexplode("linked").alias("at", "chunk_id")).groupBy("query_id", "rank", "chunk_id").agg(F.min("at").alias("at"))
    texts = links.join(chunks.select("chunk_id", strip(F.col("text")).alias("t")), "chunk_id").where("t <> ''").groupBy("query_id", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "\n\n").alias("linked_text"))
    image = strip(F.col("image_id"))
    return few.join(texts, ["query_id", "rank"], "left").select(
        "query_id", "rank", image.alias("image_id"), F.when(image != "", F.concat(F.lit(f"{base.rstrip('/')}/media/"), image)).alias("image_url"), "file_name", "page", strip(F.col("section")).alias("section"),
        first("heading", "section").alias("heading"), F.coalesce("linked_text", first("nearby", "local", "context")).alias("doc_text"), first("visual").alias("visual"), first("local", "nearby").alias("context"),
    )


def topic_hits(hits: DataFrame, topics: DataFrame) -> DataFrame:
    """hits (query_id, attempt, rank, chunk_id, file_name), topics (topic, file_name) -> each topic's hits of each query.

    Results are held against a topic's files after the search. Where a topic has none among those of the first
    attempt, those of the second (asked with a hint) are taken.
    """
    met = hits.join(topics, "file_name")
    first = met.groupBy("query_id", "topic").agg(F.min("attempt").alias("attempt"))
    return met.join(first, ["query_id", "topic", "attempt"]).select("query_id", "topic", "attempt", "rank", "chunk_id", "file_name")


IMAGE_METHODS = ("dense", "retrieve_rerank", "retrieve_rerank_fallback")


def image_search(queries: DataFrame, corpus: DataFrame, method: str, k: int, first_k: int = 15, threshold: float = 0.82) -> DataFrame:
    """One of IMAGE_METHODS over images (id, section, stage1, full): query_id, rank, id, score, method."""
    if method not in IMAGE_METHODS:
        raise ValueError(f"the method must be one of {', '.join(IMAGE_METHODS)}")
    check_sizes(k, first_k)
    if method == "dense":
        found = dense_topk(queries.select("query_id", "full"), corpus.select("id", "full"), k)
    else:
        found = gated_search(queries, corpus, k, first_k, threshold if method.endswith("fallback") else None)
    return found.select("query_id", "rank", "id", "score", F.lit(method).alias("method"))


def search_both(texts: Callable[[DataFrame], DataFrame], images: Callable[[DataFrame], DataFrame], questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text results of all questions, and image results of those that ask for looks."""
    return texts(questions), images(questions.where(keyword_intent(F.col("text")) == "visual"))


def linked_texts(contexts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, nth, chunk_id, text): text results taken from what the images of a query link."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "at", "chunk_id"))
    return linked_chunks(contexts, chunks).select("query_id", nth.alias("nth"), "chunk_id", "text")
