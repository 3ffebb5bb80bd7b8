"""Reranking by a model that is loaded once a worker and takes pairs of texts by a budget of tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import rerank

_LOADED: dict[str, PairScorer] = {}  # of this worker, by name


class PairScorer(Protocol):
    """What a reranking model offers: the size of a pair in its own tokens, and the scores of a batch of pairs."""

    def tokens(self, query: str, text: str) -> int: ...

    def scores(self, pairs: Sequence[tuple[str, str]]) -> Sequence[float]: ...


def loaded(name: str, load: Callable[[], PairScorer]) -> PairScorer:
    """The model of that name; a worker that has it keeps it for later tasks."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def batches(sizes: Sequence[int], budget: int) -> Iterator[list[int]]:
    """Places of pairs, of like sizes together, so that a batch padded to its longest is within the budget; a pair that
    is over it alone is a batch of its own."""
    batch: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        if batch and sizes[i] * (len(batch) + 1) > budget:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def scored(pairs: DataFrame, query: str, text: str, name: str, load: Callable[[], PairScorer], budget: int = 16_384, score: str = "reranker_score") -> DataFrame:
    """pairs with the model's score of each pair of texts, as a double; null texts count as empty, rows that repeat are
    scored each. A score that is no finite number raises."""

    @F.pandas_udf("double")
    def run(given: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = loaded(name, load)
        for queries, texts in given:
            both = list(zip(queries.fillna("").tolist(), texts.fillna("").tolist()))
            out = np.zeros(len(both))
            for batch in batches([max(1, model.tokens(q, t)) for q, t in both], budget):
                out[batch] = model.scores([both[i] for i in batch])
            if not np.isfinite(out).all():
                raise ValueError(f"{name} gave a score that is no finite number")
            yield pd.Series(out)

    return pairs.withColumn(score, run(query, text))


def reranked(found: DataFrame, queries: DataFrame, texts: DataFrame, k: int, name: str, load: Callable[[], PairScorer], budget: int = 16_384) -> DataFrame:
    """found(query_id, rank, id), queries(query_id, query_text), texts(id, text) -> the k best of each query by the model,
    ties by their rank: query_id, rank, id, original_rank, reranker_score. Candidates without a text are left out. Few
    candidates meet many texts: the texts are looked up by id before a worker sees them."""
    met = found.select("query_id", "id", "rank").join(texts.select("id", "text"), "id").join(queries.select("query_id", "query_text"), "query_id")
    rows = scored(met, "query_text", "text", name, load, budget).select("query_id", "id", "rank", "reranker_score")
    return rerank(rows, F.col("reranker_score"), k).select("query_id", "rank", "id", "original_rank", "reranker_score")
