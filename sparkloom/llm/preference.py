"""Preference formatting: the longest common turn prefix once as prompt, then paired masked completions.

DataFrame functions only. The turns of a pair are put together once, as a rendered conversation must be; both
sides are sets of rows, and the prompt ends before the first turn of a row that only one of them has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import digits, ranked

OPEN, CLOSE = "<|", "|>"


def render(role: Column, text: Column) -> Column:
    """One turn; inside texts, backslashes and openings of a tag are escaped so that turns can be told apart again."""
    body = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(OPEN), F.lit("<\\|"))
    return F.concat(F.lit(OPEN), role, F.lit(f"{CLOSE}\n"), body, F.lit("\n"))


def _parts(turns: DataFrame, trained: str) -> DataFrame:
    """pair_id, and arrays prompt, chosen, rejected of (turn, role, rendered, masked) in order; one grouping by pair."""
    rows = turns.where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull() & F.col("side").isin("chosen", "rejected"))
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = rows.groupBy("pair_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("side") == s, said))).alias(s) for s in ("chosen", "rejected")))
    lone = F.concat(F.array_except("chosen", "rejected"), F.array_except("rejected", "chosen"))
    split = sides.withColumn("differ", F.array_min(F.transform(lone, lambda x: x["turn"])))
    before = lambda x: F.col("differ").isNull() | (x["turn"] < F.col("differ"))

    def shown(said: Column, prompt: bool) -> Column:
        return F.transform(said, lambda x: F.struct(x["turn"], x["role"].alias("role"), render(x["role"], x["text"]).alias("rendered"), (F.lit(prompt) | (x["role"] != trained)).alias("masked")))

    return split.select(
        "pair_id", shown(F.filter("chosen", before), True).alias("prompt"),
        *(shown(F.filter(s, lambda x: ~before(x)), False).alias(s) for s in ("chosen", "rejected")),
    )


def segments(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """turns(pair_id, side 'chosen' or 'rejected', turn, role, text) -> pair_id, part, turn, nth, role, rendered, masked.

    part is prompt, chosen or rejected. A turn belongs to the prompt if, up to and including it, both sides
    have the same turns; it is rendered once. masked is true where the loss leaves a turn out: in the prompt
    and in turns of other roles than `trained`. Null roles and texts count as empty. Identical rows count once;
    different rows of one side with the same turn follow each other by role and text, and agree if all do. A
    pair with one side only has no prompt. Rows whose pair_id, side or turn is null are no turns. Other columns
    are not read; an empty table gives an empty result.
    """
    parts = F.array(*(F.struct(F.lit(s).alias("part"), F.col(s).alias("said")) for s in ("prompt", "chosen", "rejected")))
    rows = _parts(turns, trained).select("pair_id", F.inline(parts))
    return rows.select("pair_id", "part", F.posexplode("said").alias("nth", "x")).select("pair_id", "part", "x.turn", "nth", "x.role", "x.rendered", "x.masked")


def preference_pairs(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """The segments of each pair put together: pair_id, n_prompt, prompt, chosen, chosen_spans, rejected, rejected_spans.

    The spans are the unmasked parts of a completion, 'start:end' in code points, comma-joined. Rows are treated
    as segments() does.
    """
    text = lambda s: F.array_join(F.transform(s, lambda x: x["rendered"]), "")

    def spans(s: str) -> Column:
        walk = F.aggregate(
            s, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["rendered"])).alias("at"),
                F.when(x["masked"], acc["out"]).otherwise(F.concat(acc["out"], F.when(acc["out"] == "", "").otherwise(","), acc["at"].cast("string"), F.lit(":"), (acc["at"] + F.length(x["rendered"])).cast("string"))).alias("out"),
            ),
        )
        return walk["out"]

    return _parts(turns, trained).select(
        "pair_id", F.size("prompt").cast("long").alias("n_prompt"), text("prompt").alias("prompt"), text("chosen").alias("chosen"), spans("chosen").alias("chosen_spans"),
        text("rejected").alias("rejected"), spans("rejected").alias("rejected_spans"),
    )


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> turns of pairs: a conversation up to its last assistant turn is
    chosen; with that turn answered as the next one that has an assistant turn ends, by conv_id, it is rejected. The
    last of them has its chosen side only; conversations without an assistant turn make no pair. Of tied last
    turns the largest text answers. Rows with a null conv_id or turn are left out, null texts count as empty, rows
    that repeat stay; an empty table gives an empty result. What comes next is found by ranks from digit histograms."""
    said = conversations.where("role = 'assistant' AND turn IS NOT NULL AND conv_id IS NOT NULL").withColumn("conv_id", F.col("conv_id").cast("long"))
    last = said.groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    prefixes = digits(F.col("conv_id"), *said.agg(F.min("conv_id"), F.max("conv_id")).first(), "conv_id")
    places = ranked(said.groupBy("conv_id").agg(F.lit(1).alias("n")).withColumns({"all": F.lit(0), **prefixes}), ["all"], [*prefixes, "conv_id"]).select("conv_id", "before")
    answers = last.join(places, "conv_id").select("conv_id", F.col("last.turn").alias("end"), "before")
    donors = last.join(places, "conv_id").select((F.col("before") - 1).alias("before"), F.col("last.text").alias("other"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").join(answers.join(donors, "before", "left").drop("before"), "conv_id").where("turn <= end")
    sides = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text").alias("said")),
        F.struct(F.when(F.col("other").isNotNull(), "rejected").alias("side"), F.when((F.col("turn") == F.col("end")) & (F.col("role") == "assistant"), F.col("other")).otherwise(F.col("text")).alias("said")),
    )
    return rows.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.inline(sides)).where("side IS NOT NULL").withColumnRenamed("said", "text")
