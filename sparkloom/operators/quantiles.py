"""Exact percentiles by selection: histograms that narrow the interval in which a wanted rank lies.

Each pass counts the next 16 bits of the values that share a wanted rank's bits so far, so no aggregate holds more than
2^16 counts for a group and rank, however many distinct values there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 16


def percentiles(rows: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """by, and a double for each name in `wanted`: the percentile of a column of whole numbers at that share.

    Between two ranks it is their linear interpolation, as Spark's percentile and pandas have it. Null values don't
    count; a group without any has no row; null groups are groups. Without `by`, the table is one group. An empty
    table gives an empty result. Values must span less than 2^63.
    """
    if any(not 0 <= q <= 1 for q in wanted.values()):
        raise ValueError("shares lie between 0 and 1")
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    given = rows.where(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).cast("long").alias("v"))
    least, most = given.agg(F.min("v"), F.max("v")).first()
    span = 0 if least is None else most - least
    if span >= 1 << 63:
        raise ValueError("values span too much")
    keyed = given.select("g", (F.col("v") - F.lit(least or 0)).alias("u"))
    at = [F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in wanted.items()]
    asked = keyed.groupBy("g").agg((F.count("*") - 1).alias("last")).select("g", F.explode(F.array(*at)).alias("a"), "last")
    asked = asked.select("g", "a.name", (F.col("last") * F.col("a.q")).alias("at")).withColumn("low", F.floor("at"))
    # a rank and the one above it; (prefix, rest): the bits known, and the rank among the values that share them
    ranks = asked.select("g", "name", (F.col("at") - F.col("low")).alias("share"), F.explode(F.array("low", F.ceil("at"))).alias("rank")).distinct()
    found = ranks.select("g", "rank").distinct().withColumns({"prefix": F.lit(0).cast("long"), "rest": F.col("rank")})
    levels = -(-span.bit_length() // DIGIT)
    for level in reversed(range(levels)):
        shift = level * DIGIT
        held = F.shiftright("u", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("long")
        near = keyed.withColumn("prefix", held).join(found.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
        counts = near.groupBy("g", "prefix", F.shiftright("u", shift).alias("next")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g", "prefix").orderBy("next"))
        placed = counts.withColumn("upto", upto)
        found = found.join(placed, ["g", "prefix"]).where((F.col("rest") < F.col("upto")) & (F.col("rest") >= F.col("upto") - F.col("n")))
        found = found.select("g", "rank", F.col("next").alias("prefix"), (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))
    met = ranks.join(found.select("g", "rank", (F.col("prefix") + F.lit(least or 0)).alias("x")), ["g", "rank"]).groupBy("g", "name", "share").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    whole = met.withColumn("p", F.col("a").cast("double") + (F.col("b") - F.col("a")) * F.col("share"))
    wide = whole.groupBy("g").agg(*(F.max(F.when(F.col("name") == n, F.col("p"))).alias(n) for n in wanted))
    return wide.select(*(F.col("g")[c].alias(c) for c in by), *wanted)
