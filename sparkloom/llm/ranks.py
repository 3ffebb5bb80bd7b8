"""Exact ranks within groups from histograms of key digits, without a sort of a whole group.

A key is a path of columns, coarse to fine, where a parent has a bounded number of children. Counts are added up
along the path; the rows before a key are those before its parent and those of its smaller siblings. So a window
holds the children of one parent, whatever the size of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 8  # bits of a digit: a parent has 256 children at most


def digits(key: Column, least: int | None, most: int | None, name: str) -> dict[str, Column]:
    """Columns for the prefixes of a long key without nulls, the coarsest first and the key itself not among them;
    least and most bound the keys, and tell how many prefixes differ at all."""
    shift, found = DIGIT, {}
    while least is not None and shift < 64 and least >> shift != most >> shift:
        found[f"{name}_{shift}"] = F.shiftright(key, shift)
        shift += DIGIT
    if shift < 64:
        found[f"{name}_{shift}"] = F.shiftright(key, shift)  # the one prefix, or a few, that all keys share
    return dict(reversed(found.items()))


def ranked(counts: DataFrame, group: list[str], path: list[str], order: list[str] | None = None) -> DataFrame:
    """counts(group, path, n) -> the same with `before`: how many of the group come before, by n.

    The columns of the path are without nulls; `order` sorts the rows under one parent, by default the last column
    of the path. Rows with equal keys must not repeat.
    """
    *parents, last = path
    keys = [*group, *parents]
    siblings = Window.partitionBy(*keys).orderBy(*(order or [last])).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("n").over(siblings), F.lit(0).cast("long"))
    if not parents:
        return counts.withColumn("before", own)
    above = ranked(counts.groupBy(*keys).agg(F.sum("n").alias("n")), group, parents).select(*keys, F.col("before").alias("above"))
    return counts.join(above, keys).withColumn("before", own + F.col("above")).drop("above")
