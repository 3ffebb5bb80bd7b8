"""Toxicity by a classifier chain: each category's linear model is fed the earlier categories' probabilities.

While training, what later models are fed are out-of-fold predictions, so they meet earlier probabilities as
they will be for unseen texts. A model adds up weights of a text's distinct words (of the word, of its first
four and five letters, as hashes), of structural features and of the earlier probabilities.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty
from .features import STRUCTURE, Scaled, adam, sigmoid, structure

SAMPLE = 8_000  # labelled rows that the chain is fitted on, at most
FOLDS = 5
TERMS = 3_000  # word features of a model, at most: those whose share of marked texts is furthest from the mean
SEEN = 4  # labelled rows that a word feature must occur in
_WORD = re.compile(r"[^\W\d_]+")


def _hash(term: str) -> int:
    return zlib.crc32(term.encode()) - (1 << 31)


def terms(word: str) -> tuple[int, ...]:
    cut = (word[:5], word[:4]) if len(word) > 5 else (word[:4],) if len(word) > 4 else ()
    return (_hash(word), *(_hash(f"{len(c)}^{c}") for c in cut))


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _described(batches):
    """(doc_id, text, labels) -> labels, hashes of the distinct terms of distinct words, structure."""
    seen: dict[str, tuple[int, ...]] = {}
    for batch in batches:
        ids, x = [], []
        for text in batch.column(1).to_pylist():
            own: list[int] = []
            for w in words(text):
                if (t := seen.get(w)) is None:
                    if len(seen) > 200_000:
                        seen.clear()
                    t = seen[w] = terms(w)
                own += t
            ids.append(own)  # a term once for each distinct word that has it
            x.append(structure(text.encode()))
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], ["y", "terms", "x"])


class Linear:
    """Logistic regression on selected terms and dense columns."""

    def fit(self, rows: np.ndarray, hashes: np.ndarray, dense: np.ndarray, y: np.ndarray, use: np.ndarray) -> "Linear":
        """rows, hashes: a pair for each term of each text; use: the texts to learn from."""
        n = len(y)
        mine = use[rows]
        names, at = np.unique(hashes[mine], return_inverse=True)
        texts = rows[mine]
        once = np.unique(texts.astype(np.int64) * len(names) + at) if len(names) else np.zeros(0, np.int64)
        text, term = once // max(len(names), 1), once % max(len(names), 1)
        df = np.bincount(term, minlength=len(names))
        pos = np.bincount(term, weights=y[text], minlength=len(names))
        share = max(y[use].mean(), 1e-6)
        lift = np.where(df >= SEEN, np.abs(pos - df * share) / np.sqrt(df * share * (1 - share) + 1), 0)
        chosen = np.sort(np.argsort(-lift, kind="stable")[:TERMS])
        chosen = chosen[lift[chosen] > 3]
        self.names = names[chosen]
        self.scaled = Scaled(dense[use])
        d = self.scaled(dense)
        where = np.searchsorted(self.names, hashes) if len(self.names) else np.zeros(len(hashes), np.int64)
        where[where == len(self.names)] = 0
        hit = (self.names[where] == hashes) if len(self.names) else np.zeros(len(hashes), bool)
        r, c = rows[hit], where[hit]
        k, weight = len(self.names), use / use.sum()

        def margin(w: np.ndarray) -> np.ndarray:
            return np.bincount(r, weights=w[c], minlength=n) + d @ w[k:]

        ridge = np.concatenate([np.full(k, 2e-5), np.full(d.shape[1] - 1, 1e-4), [0]])

        def gradient(w: np.ndarray) -> np.ndarray:
            g = weight * (sigmoid(margin(w)) - y)
            return np.concatenate([np.bincount(c, weights=g[r], minlength=k), g @ d]) + ridge * w

        self.w = adam(gradient, np.zeros(k + d.shape[1]), 400, 0.1)
        self.margin_all = margin(self.w)
        self.table = dict(zip(self.names.tolist(), self.w[:k].tolist()))
        return self

    def dense(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.w[len(self.names) :]


def _one_fit(terms_of, data):
    """Number of a fold -> probabilities of the texts of that fold by a model of the others; FOLDS -> the model of all."""

    def run(batches):
        offsets, hashes = terms_of.value
        dense, target, known, folds = data.value
        rows = np.repeat(np.arange(len(target), dtype=np.int32), np.diff(offsets))
        for batch in batches:
            for f in batch.column(0).to_pylist():
                use = known & (folds != f)
                model = Linear().fit(rows, hashes, dense, target, use) if use.any() else None
                if f < FOLDS:
                    made = sigmoid(model.margin_all[folds == f]) if model else np.zeros((folds == f).sum())
                    out = made.tobytes()
                else:
                    if model:
                        del model.margin_all
                    out = pickle.dumps(model)
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([out], pa.binary())], ["fold", "made"])

    return run


class Chain:
    """models, and thresholds where out-of-fold F1 is best. The fits of a category are as many tasks of one job; what
    they learn from is the bounded sample."""

    def __init__(self, spark: SparkSession, categories: Sequence[str], offsets, hashes, x, y, folds):
        self.categories, self.models, self.thresholds = list(categories), [], []
        dense, terms_of = x, spark.sparkContext.broadcast((offsets, hashes))
        for j in range(len(categories)):
            known, target = ~np.isnan(y[:, j]), np.nan_to_num(y[:, j])
            data = spark.sparkContext.broadcast((dense, target, known, folds))
            tasks = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(_one_fit(terms_of, data), "fold long, made binary")
            made = {r.fold: r.made for r in tasks.collect()}  # FOLDS + 1 rows
            held = np.zeros(len(y))
            for f in range(FOLDS):
                held[folds == f] = np.frombuffer(made[f])
            self.models.append(pickle.loads(made[FOLDS]))
            self.thresholds.append(self._threshold(held[known], target[known]))
            data.unpersist()
            dense = np.hstack([dense, held[:, None]])
        terms_of.unpersist()

    @staticmethod
    def _threshold(p: np.ndarray, y: np.ndarray) -> float:
        best = max(((2 * ((p >= t) & (y > 0)).sum() / max((p >= t).sum() + (y > 0).sum(), 1), -abs(t - 0.5), t) for t in np.arange(0.05, 0.96, 0.05)), default=(0, 0, 0.5))
        return float(best[2]) if best[0] > 0 else 0.5

    def scores(self, texts: list[str], seen: dict[str, tuple[float, ...]]) -> np.ndarray:
        sums = np.zeros((len(texts), len(self.models)))
        for i, text in enumerate(texts):
            own = words(text)
            if len(seen) > 300_000:
                seen.clear()
            for w in own:
                if w not in seen:
                    t = terms(w)
                    v = tuple(sum(m.table.get(h, 0.0) for h in t) if m else 0.0 for m in self.models)
                    seen[w] = v if any(v) else ()
            for v in map(seen.__getitem__, own):
                if v:
                    sums[i] += v
        dense = np.array([structure(t.encode()) for t in texts], np.float32).astype(np.float64).reshape(-1, STRUCTURE)
        out = []
        for j, m in enumerate(self.models):
            p = sigmoid(sums[:, j] + m.dense(dense)) if m else np.full(len(texts), 0.5)
            out.append(p)
            dense = np.hstack([dense, p[:, None]])
        return np.array(out).T.reshape(len(texts), -1)


def _scorer(shared):
    def run(batches):
        chain, seen = shared.value, {}
        for batch in batches:
            p = chain.scores(batch.column(1).to_pylist(), seen)
            columns = [batch.column(0)]
            for j, t in enumerate(chain.thresholds):
                columns += [pa.array(p[:, j]), pa.array(p[:, j] >= t)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(n for c in chain.categories for n in (f"p_{c}", c))])

    return run


def fitted(documents: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> Chain:
    """The chain over the label columns `categories`, in that order; a null label leaves a text out of that model only."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array(*(F.max(c).cast("double") for c in categories)).alias("y"))
    # the labelled rows are chosen by a hash of their ids before any text moves
    picked = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = docs.join(picked, "doc_id").mapInArrow(_described, "y array<double>, terms array<int>, x array<float>").toArrow().combine_chunks()
    n = got.num_rows
    lists = [got["terms"].combine_chunks(), got["x"].combine_chunks(), got["y"].combine_chunks()] if n else []
    offsets = lists[0].offsets.to_numpy() if n else np.zeros(1, np.int32)
    hashes = lists[0].flatten().to_numpy() if n else np.zeros(0, np.int32)
    x = lists[1].flatten().to_numpy().astype(np.float64).reshape(-1, STRUCTURE) if n else np.zeros((0, STRUCTURE))
    y = lists[2].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(categories)) if n else np.zeros((0, len(categories)))
    order = np.lexsort(x.T) if n else np.zeros(0, np.int64)  # folds must not follow the order of arrival
    folds = np.empty(n, np.int64)
    folds[order] = np.arange(n) % FOLDS
    return Chain(docs.sparkSession, categories, offsets, hashes, x, y, folds)


def toxicity(spark: SparkSession, documents: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> DataFrame:
    """documents(doc_id, text), labels(doc_id, categories...) -> doc_id, and for each category p_<category> and the
    decision <category>: one row for each input row.

    Null and empty texts are scored as texts without words. Labels that repeat a doc_id count as the largest.
    Without labels every probability is 0.5. Other columns are not read.
    """
    chain = fitted(documents, labels, categories, sample)
    shared = spark.sparkContext.broadcast(chain)
    columns = ", ".join(f"p_{c} double, {c} boolean" for c in categories)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_scorer(shared), f"doc_id long, {columns}")
