"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and unlabelled web text are told apart first; the ratio of unlabelled to positive mass
above each score, over all rows, gives the class prior. Then a linear model on structural features minimises
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) under the logistic loss, so its sigmoid estimates the chance
of the positive class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, binaries, text_or_empty
from .features import STRUCTURE, Scaled, adam, sigmoid, structure

SAMPLE = 20_000  # rows of each kind that the model is fitted on, at most
THRESHOLD = 0.3
_BINS = 400


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _structures(batches):
    for batch in batches:
        flat = [structure(t) for t in binaries(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat, pa.list_(pa.float32()))], ["doc_id", "x"])


def features(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_structures, "doc_id long, x array<float>")


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, STRUCTURE)


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """At most n feature rows, by the order of a hash of their ids."""
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("x").toArrow()
    return matrix(got.column(0).combine_chunks()) if got.num_rows else np.zeros((0, STRUCTURE))


class Model:
    def __init__(self, scaled: Scaled, w: np.ndarray):
        self.scaled, self.w = scaled, w

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scaled(x) @ self.w)


def _scorer(shared):
    def run(batches):
        for batch in batches:
            s = shared.value.scores(matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    return run


def scored(spark: SparkSession, rows: DataFrame, model: Model) -> DataFrame:
    return rows.select("doc_id", "x").mapInArrow(_scorer(spark.sparkContext.broadcast(model)), "doc_id long, score double")


def prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """From histograms of scores: the least ratio of unlabelled to positive mass above a threshold that a fifth
    of the positives pass; where no negative passes, that ratio is the prior."""
    p, u = (np.cumsum(h[::-1]) / max(h.sum(), 1) for h in (positive, unlabelled))
    ok = p >= 0.2
    return float(np.clip((u[ok] / p[ok]).min(initial=1.0), 0.05, 0.99))


def nnpu(p: np.ndarray, u: np.ndarray, pi: float, steps: int = 600, ridge: float = 1e-4) -> np.ndarray:
    """Weights that minimise the non-negative risk with the logistic loss."""

    def gradient(w: np.ndarray) -> np.ndarray:
        fp, fu = p @ w, u @ w
        minus = np.logaddexp(0, fu).mean() - pi * np.logaddexp(0, fp).mean()
        g = -pi * (p * sigmoid(-fp)[:, None]).mean(0)
        if minus >= 0:
            g += (u * sigmoid(fu)[:, None]).mean(0) - pi * (p * sigmoid(fp)[:, None]).mean(0)
        return g + ridge * np.append(w[:-1], 0)

    return adam(gradient, np.zeros(p.shape[1]), steps)


def fitted(spark: SparkSession, rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """rows(doc_id, x); labels(doc_id, quality). Learns from rows that are not held out; positives are rows of
    quality 1, all others count as unlabelled web text. Without positives or others, every score is 0.5."""
    free = rows.where(~held_out(F.col("doc_id")))
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    positives = free.join(trusted, "doc_id", "left_semi")
    x_p, x_u = _sample(positives, sample), _sample(free, sample)
    scaled = Scaled(x_u if len(x_u) else np.zeros((1, STRUCTURE)))
    if not len(x_p) or not len(x_u):
        return Model(scaled, np.zeros(STRUCTURE + 1))
    p, u = scaled(x_p), scaled(x_u)

    def apart(w: np.ndarray) -> np.ndarray:
        return ((u * sigmoid(u @ w)[:, None]).mean(0) - (p * sigmoid(-(p @ w))[:, None]).mean(0)) / 2 + 1e-3 * np.append(w[:-1], 0)

    first = Model(scaled, adam(apart, np.zeros(p.shape[1]), 300))
    bins = F.least(F.floor(F.col("score") * _BINS), F.lit(_BINS - 1)).alias("bin")
    marked = scored(spark, free, first).join(trusted.withColumn("trusted", F.lit(True)), "doc_id", "left")
    counts = marked.groupBy(bins).agg(F.count("*").alias("u"), F.count("trusted").alias("p")).collect()  # _BINS rows at most
    h_p, h_u = np.zeros(_BINS), np.zeros(_BINS)
    for b, n_u, n_p in counts:
        h_p[b], h_u[b] = n_p, n_u
    return Model(scaled, nnpu(p, u, prior(h_p, h_u)))


def quality_scores(spark: SparkSession, documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """documents(doc_id, text), labels(doc_id, quality) -> doc_id, held_out, score, predicted: a row for each input row.

    Null and empty texts get the score of a text without words. A null doc_id is not held out and has no label.
    Rows that repeat a doc_id are scored each. Other columns are not read.
    """
    rows = Tables(spark).keep(features(documents), "features")
    return (
        scored(spark, rows, fitted(spark, rows, labels, sample))
        .select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score")
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def _kept(shared, threshold: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([structure(t or b"") for t in binaries(batch.column(batch.schema.get_field_index("text")))], np.float32).astype(np.float64)
                yield batch.filter(pa.array(shared.value.scores(x) >= threshold))

    return run


def quality_kept(spark: SparkSession, documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """documents without the rows scored below the threshold; all columns stay."""
    tables = Tables(spark)
    model = fitted(spark, tables.keep(features(documents), "features"), labels, sample)
    tables.drop("features")
    return documents.mapInArrow(_kept(spark.sparkContext.broadcast(model), threshold), documents.schema)
