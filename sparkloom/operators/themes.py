"""Themes that a text names: one automaton over all aliases, instead of a pattern for each."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

BOUND = 1_000_000  # aliases that are sent to tasks in one automaton
_BLANKS = re.compile(r"\s+")


def plain(text: str | None) -> str:
    """Small letters, with one blank where there are any."""
    return _BLANKS.sub(" ", (text or "").lower()).strip()


def automaton(aliases: dict[str, set[str]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for alias, themes in aliases.items():
        found.add_word(alias, (len(alias), sorted(themes)))
    found.make_automaton()
    return found


def named(text: str | None, words: ahocorasick.Automaton) -> set[str]:
    """Themes of which an alias stands in the text, with no letter, digit or underscore next to it."""
    said, themes = plain(text), set()
    joins = lambda c: c == "_" or c.isalnum()
    for end, (size, names) in words.iter(said) if len(words) else ():
        begin = end - size + 1
        if not (begin and joins(said[begin - 1])) and not (end + 1 < len(said) and joins(said[end + 1])):
            themes.update(names)
    return themes


def theme_mentions(docs: DataFrame, aliases: DataFrame, bound: int = BOUND) -> DataFrame:
    """docs(id, text), aliases(theme, alias) -> id, theme: a row for each theme that a row of docs names.

    An alias is found in either case and across any blanks, as whole words. Null and blank aliases and null themes name
    nothing, null texts name nothing, rows of docs that repeat have rows each. Other columns are not read. The aliases
    are read once and sent to all tasks; more than `bound` of them raise.
    """
    some = aliases.where("theme IS NOT NULL AND alias IS NOT NULL").select(aliases["theme"].cast("string").alias("theme"), "alias").distinct().limit(bound + 1).collect()
    if len(some) > bound:
        raise ValueError(f"more than {bound} aliases; search them in parts")
    known: dict[str, set[str]] = {}
    for theme, alias in some:
        if plain(alias):
            known.setdefault(plain(alias), set()).add(theme)
    shared = docs.sparkSession.sparkContext.broadcast(automaton(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, themes = [], []
            for i, text in enumerate(batch.column(1)):
                for theme in sorted(named(text.as_py(), shared.value)):
                    at.append(i)
                    themes.append(theme)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(themes, pa.string())], ["id", "theme"])

    return docs.select(docs["id"].cast("long").alias("id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "id long, theme string")
