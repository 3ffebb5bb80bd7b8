"""Secret scans: patterns, and sliding-window Shannon entropy per character class. DataFrame functions only.

Positions come from splitting a text at the matches of a pattern and adding up lengths, all of them at once by running
sums of 1, 2, 4, ... neighbours. Over a candidate string, a window's symbol counts and the sum of c * log2(c) are
carried along, one symbol entering and one leaving at each step, so each window's entropy is log2(w) - sum / w. Counts
are five bits each, twelve to a long, so that a step changes two of a few numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Fixed patterns of the contract: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Character classes: kind, alphabet (as the counts' order), candidate pattern, window, least bits a symbol.
CLASSES = (
    ("hex_entropy", "0123456789abcdefABCDEF", r"[0-9A-Fa-f]{16,}", 16, 3.0),
    ("base64_entropy", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.9),
)
# Candidates that match one of these as a whole are no secrets. Loops of groups are possessive: a loop that can go back
# takes stack for each of its rounds, and a candidate has any length.
ALLOWED = (
    r"[0-9]+",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?:0123456789abcdefghijklmnopqrstuvwxyz|0123456789abcdef|abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ|0123456789)++",
    r"(?:[A-Za-z]+[/_-])++[A-Za-z]+",
)
_BITS, _PACKED = 5, 12  # of a count, and counts in a long


def _entropy_hull(candidate: str, alphabet: str, window: int, bits: float) -> str:
    """(b, e): first symbol of the first window and last of the last whose entropy is at least bits, from 1; or 0, 0."""
    if window >= 1 << _BITS:
        raise ValueError(f"a window holds fewer than {1 << _BITS} symbols")
    f = "array(" + ",".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(window + 1)) + ")"
    hot = f"({math.log2(window)!r}D - acc.s / {window} >= {bits!r}D)"
    place = lambda code: f"({code} div {_PACKED})"
    one = lambda code: f"shiftleft(1L, cast({_BITS} * ({code} % {_PACKED}) AS INT))"
    count = lambda code: f"cast(shiftright(acc.n[{place(code)}], cast({_BITS} * ({code} % {_PACKED}) AS INT)) & {(1 << _BITS) - 1} AS INT)"
    enters, leaves = "codes[i - 1]", f"codes[i - 1 - {window}]"
    # the codes stand outside of what is carried along, which is copied at each step
    return f"""transform(array(transform(split({candidate}, ''), c -> instr('{alphabet}', c) - 1)), codes -> aggregate(
        sequence(1, length({candidate})),
        named_struct('n', array_repeat(0L, {-(-len(alphabet) // _PACKED)}), 's', 0D, 'b', 0, 'e', 0),
        (acc, i) -> named_struct(
            'n', CASE WHEN i <= {window} THEN transform(acc.n, (v, k) -> CASE WHEN k = {place(enters)} THEN v + {one(enters)} ELSE v END)
                 WHEN {enters} = {leaves} THEN acc.n
                 ELSE transform(acc.n, (v, k) -> v + CASE WHEN k = {place(enters)} THEN {one(enters)} ELSE 0L END - CASE WHEN k = {place(leaves)} THEN {one(leaves)} ELSE 0L END) END,
            's', CASE WHEN i <= {window} THEN acc.s + {f}[{count(enters)} + 1] - {f}[{count(enters)}]
                 WHEN {enters} = {leaves} THEN acc.s
                 ELSE acc.s + {f}[{count(enters)} + 1] - {f}[{count(enters)}] + {f}[{count(leaves)} - 1] - {f}[{count(leaves)}] END,
            'b', CASE WHEN acc.b = 0 AND i > {window} AND {hot} THEN i - {window} ELSE acc.b END,
            'e', CASE WHEN i > {window} AND {hot} THEN i - 1 ELSE acc.e END),
        acc -> named_struct(
            'b', CASE WHEN acc.b = 0 AND size(codes) >= {window} AND {hot} THEN size(codes) + 1 - {window} ELSE acc.b END,
            'e', CASE WHEN size(codes) >= {window} AND {hot} THEN size(codes) ELSE acc.e END)))[0]"""


_SPANS = "array<struct<start: int, nth: int, kind: string, end: int>>"


def secret_spans(documents: DataFrame, classes: Sequence[tuple] = CLASSES, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """documents(doc_id, text) -> doc_id, spans array of (start, nth, kind, end): one row for each input row.

    Spans are in code points, end exclusive, by start and then kind in the order of BASE and CLASSES (nth). A
    candidate of a class that one of `allowed` matches as a whole gives no entropy span; base spans always stay.
    Null and empty texts have no spans. Rows that repeat are scanned each. Other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    kinds: list[Column] = []
    for nth, (kind, pattern, group, least) in enumerate(BASE):
        p, found = F.lit(pattern), f"found_{kind}"
        gaps, texts, values = (f"{found}_{x}" for x in ("gap", "m", "v"))
        hit = F.col("text").rlike(pattern)
        rows = rows.withColumns({
            texts: F.when(hit, F.regexp_extract_all("text", p, F.lit(0))),
            gaps: F.when(hit, F.split("text", pattern, -1)),
            values: F.when(hit, F.regexp_extract_all("text", p, F.lit(group))),
        })
        kinds.append(_spans(texts, gaps, nth, kind, f"length({values}[i]) >= {least}", "0", f"length({texts}[i])"))
    for nth, (kind, alphabet, pattern, window, bits) in enumerate(classes, len(BASE)):
        p, found = F.lit(pattern), f"found_{kind}"
        gaps, texts, hulls = (f"{found}_{x}" for x in ("gap", "m", "v"))
        hit = F.col("text").rlike(pattern)
        rows = rows.withColumns({texts: F.when(hit, F.regexp_extract_all("text", p, F.lit(0))), gaps: F.when(hit, F.split("text", pattern, -1))})
        plain = "^(?:" + "|".join(f"(?:{a})" for a in allowed) + ")$" if allowed else "(?!)"
        quoted = plain.replace("\\", "\\\\").replace("'", "\\'")
        rows = rows.withColumn(hulls, F.expr(f"transform({texts}, m -> CASE WHEN m RLIKE '{quoted}' THEN named_struct('b', 0, 'e', 0) ELSE {_entropy_hull('m', alphabet, window, bits)} END)"))
        kinds.append(_spans(texts, gaps, nth, kind, f"{hulls}[i].b > 0", f"{hulls}[i].b - 1", f"{hulls}[i].e"))
    empty = F.expr(f"cast(array() as {_SPANS})")
    return rows.select("doc_id", F.array_sort(F.concat(*(F.coalesce(k, empty) for k in kinds))).alias("spans"))


def _spans(texts: str, gaps: str, nth: int, kind: str, condition: str, begin: str, end: str) -> Column:
    """Spans of the matches that meet the condition; begin and end are offsets in match i. A match ends after all gaps
    up to it and all matches up to it."""
    ends = f"""aggregate(sequence(0, 30), transform({texts}, (m, i) -> length({gaps}[i]) + length(m)),
        (a, k) -> CASE WHEN size(a) <= shiftleft(1, k) THEN a ELSE transform(a, (x, i) -> CASE WHEN i < shiftleft(1, k) THEN x ELSE x + a[i - shiftleft(1, k)] END) END)"""
    return F.expr(f"""transform(filter(transform({ends}, (at, i) -> named_struct(
        'start', at - length({texts}[i]) + {begin}, 'ok', {condition}, 'end', at - length({texts}[i]) + {end})), x -> x.ok), x -> named_struct('start', x.start, 'nth', {nth}, 'kind', '{kind}', 'end', x.end))""")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
