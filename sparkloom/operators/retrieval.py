"""Retrieval: exact dense search, TF-IDF, rank fusion, reranking, theme order, gated two-stage search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1024  # vectors packed into one row


def check_sizes(k: int, candidates: int | None = None) -> None:
    """k is a positive whole number, and there are as many candidates as results at least."""
    for n in (k, *(() if candidates is None else (candidates,))):
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise ValueError("sizes must be positive whole numbers")
    if candidates is not None and candidates < k:
        raise ValueError("there must be as many candidates as results at least")


def _tiles(rows: DataFrame, id_col: str, vector: str, section: str | None) -> DataFrame:
    """TILE rows at a time packed into one: ids, sections as strings, and unit vectors as bytes of doubles. Vectors that
    are null or zero, or hold a null or non-finite number, are left out."""

    def pack(batches):
        for batch in batches:
            for b in range(0, batch.num_rows, TILE):
                part = batch.slice(b, TILE)
                part = part.filter(part.column(2).is_valid())
                if not part.num_rows:
                    continue
                lengths = part.column(2).value_lengths().to_numpy()
                if (lengths != lengths[0]).any():
                    raise ValueError("vectors must be of one length")
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                norm = np.linalg.norm(x, axis=1)
                good = np.isfinite(norm) & (norm > 0)
                if not good.all():
                    part, x, norm = part.filter(pa.array(good)), x[good], norm[good]
                    if not len(x):
                        continue
                x = x / norm[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).to_pylist()], pa.list_(pa.string())), pa.array([x.tobytes()], pa.binary())], ["ids", "sections", "x"])

    named = F.col(section).cast("string") if section else F.lit(None).cast("string")
    return rows.select(F.col(id_col).cast("long").alias("i"), named.alias("s"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(pack, "ids array<long>, sections array<string>, x binary")


def _top(s: np.ndarray, asked: np.ndarray, names: np.ndarray, k: int) -> pa.RecordBatch:
    """Scores of each of `asked` (rows) for each of `names` -> the k best of each row that are finite, ties to smaller ids."""
    kth = np.partition(s, max(len(names) - k, 0), axis=1)[:, max(len(names) - k, 0)]
    r, c = np.nonzero((s >= kth[:, None]) & np.isfinite(s))
    order = np.lexsort((names[c], -s[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return pa.RecordBatch.from_arrays([pa.array(asked[r[keep]]), pa.array(names[c[keep]]), pa.array(s[r[keep], c[keep]])], ["query_id", "id", "score"])


def _tile_top(k: int, own: bool, gated: bool):
    """Pairs of a tile of queries and one of rows -> the k best rows of the tile for each query. Pairs are read where they lie
    in the batch, one after the other, so that no batch of them is copied; sections are compared as numbers."""

    def run(batches):
        for batch in batches:
            c = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                asked, names = (c[n][i].values.to_numpy() for n in ("q_ids", "ids"))
                q, x = (np.frombuffer(c[n][i].as_buffer()).reshape(len(ids), -1) for n, ids in (("q_x", asked), ("x", names)))
                s = np.round(q @ x.T, 9)
                if own:
                    s[asked[:, None] == names[None, :]] = -np.inf
                if gated:
                    both = pa.concat_arrays([c["q_sections"][i].values, c["sections"][i].values])
                    kinds = both.dictionary_encode("encode").indices.to_numpy()
                    s[kinds[: len(asked), None] != kinds[None, len(asked) :]] = -np.inf
                yield _top(s, asked, names, k)

    return run


def _best(queries: DataFrame, corpus: DataFrame, k: int, exclude_own: bool = False, section: tuple[str, str] | None = None) -> DataFrame:
    """queries (query_id, vector, ...) and corpus (id, vector, ...) -> the k best of each query, tile by tile. With a
    pair of column names, only rows whose section is the query's."""
    mine, theirs = section or (None, None)
    q = _tiles(queries, "query_id", queries.columns[1], mine).toDF("q_ids", "q_sections", "q_x")
    # every tile of queries meets every tile of rows: k rows a query leave each, and nothing passes the driver
    pairs = _tiles(corpus, "id", corpus.columns[1], theirs).crossJoin(q)
    return ranked(pairs.mapInArrow(_tile_top(k, exclude_own, section is not None), "query_id long, id long, score double"), k)


def ranked(scores: DataFrame, k: int, by: str = "query_id", ties: Sequence[str] = ("id",)) -> DataFrame:
    """rank from 1 by falling score, at most k a query."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), *ties))).where(F.col("rank") <= k)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, exclude_own: bool = False) -> DataFrame:
    """(query_id, vector), (id, vector) -> query_id, rank, id, score: exact cosine in double precision, to nine places.

    Queries and rows are packed into tiles, and each pair of tiles gives k rows a query at most. Vectors must be of one
    length; queries and rows without a direction (null or zero, or with null or non-finite numbers) take no part.
    """
    check_sizes(k)
    return _best(queries, corpus, k, exclude_own)


def normalised(vector: Column) -> Column:
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / norm)


def prefixed(text: Column, model: str, query: bool) -> Column:
    return F.concat(F.lit("query: " if query else "passage: "), text) if "e5" in model.lower() else text


def encoded(df: DataFrame, text_col: str, encode: Callable[[list[str]], np.ndarray], name: str = "vector") -> DataFrame:
    """Unit vectors of an encoder given as a function of a batch of texts; zero or non-finite vectors raise."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        x = np.asarray(encode(texts.fillna("").tolist()), np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if not np.isfinite(x).all() or (norm == 0).any():
            raise ValueError("zero or non-finite vector")
        return pd.Series(list(x / norm))

    return df.withColumn(name, vectors(text_col))


TOKEN = r"[\p{L}\p{N}_]{2,}"


def terms(text: Column) -> Column:
    """Lower-case tokens of two characters or more, then bigrams of neighbours."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    pairs = F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(tokens, pairs)


def term_keys(text: Column) -> Column:
    """64-bit hashes of the same terms, made without the strings of pairs; the tokens are cut once."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))

    def keys(t: Column) -> Column:
        pairs = F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        return F.concat(F.transform(t, lambda x: F.xxhash64(x)), pairs)

    return F.flatten(F.transform(F.array(tokens), keys))


def tfidf(docs: DataFrame, id_col: str, text_col: str, idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, term, weight) with sublinear counts, smooth idf and unit length; and (term, idf). Terms that a given
    idf table lacks are left out."""
    counts = docs.select(id_col, F.explode(terms(F.col(text_col))).alias("term")).groupBy(id_col, "term").count()
    if idf is None:
        n = docs.agg(F.count("*").cast("double").alias("n"))  # one row
        idf = counts.groupBy("term").count().crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("count"))) + 1).alias("idf"))
    # by merging: the table of terms grows with the texts
    raw = counts.join(idf.hint("merge"), "term").select(id_col, "term", ((1 + F.ln("count")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))  # of a text's own terms
    return raw.select(id_col, "term", (F.col("w") / norm).alias("weight")), idf


def _bags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term keys of each row -> offsets of rows, distinct keys of each in order, how often each occurs there."""
    lists = batch.column(batch.num_columns - 1)
    keys, row = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return np.searchsorted(row[at], np.arange(batch.num_rows + 1)), keys[at], np.diff(np.append(at, len(keys)))


def counted(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, text) -> id, term, c: the distinct terms of each row, counted within the row."""

    def count(batches):
        for batch in batches:
            offsets, keys, c = _bags(batch)
            at, many = pa.array(offsets, pa.int32()), pa.array(c, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, keys), pa.ListArray.from_arrays(at, many)], ["id", "terms", "counts"])

    found = rows.select(F.col(id_col).cast("long").alias("id"), term_keys(F.coalesce("text", F.lit("")))).mapInArrow(count, "id long, terms array<long>, counts array<int>")
    return found.select(F.col("id").alias(id_col), F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("c"))))


def rrf(lists: Sequence[tuple[DataFrame, float]], k: int, constant: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of (query_id, id, rank) lists; ties by the first list and rank an id is in."""
    check_sizes(k)
    if constant < 0 or any(w < 0 for _, w in lists) or not any(w for _, w in lists):
        raise ValueError("weights must be >= 0, not all 0, and the constant >= 0")
    parts = [df.select("query_id", "id", F.lit(i).alias("list_no"), "rank", (F.lit(float(w)) / (constant + F.col("rank"))).alias("part")) for i, (df, w) in enumerate(lists)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    return ranked(fused, k, ties=("first", "id")).drop("first")


def hybrid(dense: DataFrame, lexical: DataFrame, k: int, candidates: int = 30, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Fusion of the first `candidates` of a dense and a lexical ranking (query_id, rank, id)."""
    check_sizes(k, candidates)
    few = lambda df: df.where(F.col("rank") <= candidates)
    return rrf([(few(dense), weights[0]), (few(lexical), weights[1])], k)


def hybrid_reranked(dense: DataFrame, lexical: DataFrame, score: Callable[[DataFrame], DataFrame], k: int, rerank_k: int = 30) -> DataFrame:
    """A fusion of max(30, rerank_k) candidates, put in the order of reranker_score, which `score` adds to the rows."""
    check_sizes(k)
    most = max(30, rerank_k)
    return rerank(score(hybrid(dense, lexical, most, most)), F.col("reranker_score"), k)


def multi_query(found: DataFrame, variants: DataFrame, k: int, candidates: int = 20) -> DataFrame:
    """Fusion of the rankings of each question's variants: found (query_id, rank, id), variants (parent, query_id, text).

    Variants with the same text count once, the one with the smallest query_id.
    """
    check_sizes(k, candidates)
    once = variants.groupBy("parent", "text").agg(F.min("query_id").alias("query_id"))
    rows = found.where(F.col("rank") <= candidates).join(once, "query_id")
    fused = rows.groupBy(F.col("parent").alias("query_id"), "id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"), F.min(F.struct(F.col("query_id").alias("v"), "rank")).alias("first"))
    return ranked(fused, k, ties=("first", "id")).drop("first")


def query_variants(cache: DataFrame, questions: DataFrame, model: str, n: int) -> DataFrame:
    """questions (query) with `variants`: the question first, then those that the cache (query, model, variant_count,
    variants) holds for the model and number, without repeats and blanks; the question alone where it holds none."""
    known = cache.where((F.col("model") == model) & (F.col("variant_count") == n)).groupBy("query").agg(F.max("variants").alias("more"))
    trimmed = F.transform(F.coalesce("more", F.array().cast("array<string>")), lambda v: F.trim(v))
    kept = F.filter(F.array_distinct(F.concat(F.array("query"), trimmed)), lambda v: v != "")
    return questions.join(known, "query", "left").withColumn("variants", F.slice(kept, 1, n + 1)).drop("more")


def rerank(found: DataFrame, score: Column, k: int) -> DataFrame:
    """Candidates in the order of another score, ties by their rank; original_rank and reranker_score are kept."""
    rows = found.withColumn("original_rank", F.col("rank")).withColumn("reranker_score", score)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("reranker_score"), "original_rank"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def theme_aliases(stems: DataFrame, stem: str, word: str) -> DataFrame:
    """(stem, aliases) of stems that are `word` or end in _word: the phrase, and the phrase without the word, longest first."""
    phrase = F.trim(F.regexp_replace(F.lower(stem), r"[_\\-]+", " "))
    bare = F.trim(F.regexp_replace(phrase, rf"\b{word}\b", " "))
    made = F.filter(F.array_distinct(F.array(phrase, bare)), lambda x: x != "")
    longest = F.array_sort(made, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    return stems.where((F.lower(stem) == word) | F.lower(stem).endswith(f"_{word}")).select(stem, longest.alias("aliases"))


def mentions(text: Column, aliases: Column) -> Column:
    """Whether one of the aliases stands in the text as whole words, in either case."""
    return F.exists(aliases, lambda a: F.rlike(text, F.concat(F.lit(r"(?iU)(?<!\w)"), F.regexp_replace(F.regexp_replace(a, r"([^\w\s])", r"\\$1"), r"\s+", r"\\s+"), F.lit(r"(?!\w)"))))


def matched_first(found: DataFrame, matched: Column) -> DataFrame:
    """The same rows, matched ones first, each part by score; a query without a match keeps its order."""
    w = Window.partitionBy("query_id")
    rows = found.withColumn("matched", matched).withColumn("any", F.max(matched.cast("int")).over(w))
    place = F.row_number().over(w.orderBy(F.when(F.col("any") == 1, F.when(F.col("matched"), 0).otherwise(1)).otherwise(0), F.when(F.col("any") == 1, -F.coalesce(F.col("score"), F.lit(0.0))).otherwise(0.0), "rank"))
    return rows.withColumn("rank", place).drop("any")


def gated_search(queries: DataFrame, corpus: DataFrame, k: int, first_k: int = 15, fallback: float | None = None) -> DataFrame:
    """Two stages: queries (query_id, stage1, full), corpus (id, section, stage1, full).

    The first stage's candidates are scored on full vectors; the best is the anchor, and the result is the best k
    of the anchor's section over the whole corpus (of everything, where it has none). With `fallback`, a query
    whose best score is below it gets plain dense results instead; only such queries are searched so. Adds
    fallback_used and confidence.
    """
    check_sizes(k, first_k)
    first = _best(queries.select("query_id", "stage1"), corpus.select("id", "stage1"), first_k)
    cosine = F.round(F.aggregate(F.zip_with(normalised(F.col("qfull")), normalised(F.col("full")), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 9)
    asked = queries.select("query_id", F.col("full").alias("qfull"))
    scored = first.select("query_id", "id").join(corpus.select("id", "section", "full"), "id").join(asked, "query_id").withColumn("score", cosine)
    anchors = scored.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"), F.col("section").cast("string").alias("section")))["section"].alias("anchor"))
    gate = asked.join(anchors.where(F.length("anchor") > 0), "query_id")
    gated = _best(gate.select("query_id", "qfull", "anchor"), corpus.select("id", "full", "section"), k, section=("anchor", "section"))
    confidence = gated.where("rank = 1").select("query_id", F.col("score").alias("confidence"))
    limit = F.lit(float("-inf") if fallback is None else fallback)
    use = queries.select("query_id", "full").join(confidence, "query_id", "left").withColumn("fallback_used", F.coalesce(F.col("confidence") < limit, F.lit(True)))
    dense = _best(use.where("fallback_used").select("query_id", "full"), corpus.select("id", "full"), k)
    return gated.join(use.where("NOT fallback_used").drop("full"), "query_id").unionByName(dense.join(use.where("fallback_used").drop("full"), "query_id"))


# Fixed hints of a question about looks.
VISUAL_HINTS = ("look like", "looks like", "show me", "show ", "photo", "image", "design", "invitation", "bouquet", "decor", "aesthetic", "visual", "picture", "style of", "how should .* look")


def keyword_intent(query: Column) -> Column:
    """'visual' where a query holds a hint as it stands, the last one's dot and star too; else 'text'."""
    low = F.lower(query)
    return F.when(F.exists(F.array(*map(F.lit, VISUAL_HINTS)), lambda h: F.contains(low, h)), "visual").otherwise("text")
