"""Guards: what a message or an answer may say, what a router plan may hold, and which SQL may run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed patterns: what must match, on lower-cased text.
INPUT_PATTERNS = (
    r"\b(ignore|disregard|override)\b.*\b(previous|earlier|all)\b.*\binstructions?\b",
    r"\b(forget|discard)\b.*\b(previous|earlier|all)\b.*\binstructions?\b",
    r"\b(reveal|show|display|expose|print)\b.*\b(system|hidden|internal)\b.*\b(prompt|instructions?)\b",
    r"\bwhat\b.*\b(system|hidden|internal)\b.*\b(prompt|instructions?)\b",
    r"\b(ignore|bypass|disable)\b.*\b(safety|guardrails?|restrictions?)\b",
    r"\b(act|pretend)\b.*\bas\b.*\b(developer|system)\b",
    r"\byou are now\b.*\b(developer|system)\b",
)
# Fixed patterns: in either case, on the answer as it is.
OUTPUT_PATTERNS = (
    r"\b(api|secret|access)\s*key\s*(is|:|=)\s*\S+",
    r"\bpassword\s*(is|:|=)\s*\S+",
    r"\bbearer\s+[a-zA-Z0-9._\-]+",
    r"\bsk-[a-zA-Z0-9]{20,}\b",
    r"\bAIza[a-zA-Z0-9_\-]{20,}\b",
    r"\b(my|the)\s+system\s+prompt\s+(is|contains|says)\b",
    r"\bhere\s+(is|are)\s+(my|the)\s+(hidden|internal|system)\s+instructions?\b",
)
# Fixed words: what a statement may not hold.
BLOCKED = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "REPLACE", "GRANT", "REVOKE", "EXEC", "CALL")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def _any(text: Column, patterns) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return hit


def input_reason(message: Column, most: int = 1000) -> Column:
    """Why a message is refused, or null; white space around it doesn't count."""
    text = _stripped(message)
    return F.when(text == "", "empty").when(F.length(text) > most, "too_long").when(_any(F.lower(text), INPUT_PATTERNS), "injection")


def output_reason(answer: Column) -> Column:
    """Why an answer is held back, or null."""
    text = _stripped(answer)
    return F.when(text == "", "empty").when(_any(text, [f"(?i){p}" for p in OUTPUT_PATTERNS]), "sensitive")


def routed(agents: Column, allowed: tuple[str, ...], most: int = 2, fallback: str = "sql_agent") -> Column:
    """Allowed agents of a plan, each once, `most` at most; the fallback if none is left."""
    kept = F.slice(F.array_distinct(F.filter(agents, lambda a: a.isin(*allowed))), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(fallback)))


def sql_problem(statement: str) -> str | None:
    """Why a statement is not run: it must be one SELECT or SHOW without a blocked word, in strings or out of them."""
    text = statement.strip().rstrip(";").strip()
    if not re.match(r"(?i)(select|show)\b", text):
        return "only SELECT and SHOW"
    if found := re.search(rf"(?i)\b({'|'.join(BLOCKED)})\b", text):
        return f"{found[1].upper()} is not allowed"
    return None


def run_sql(spark: SparkSession, statement: str, limit: int = 50) -> DataFrame:
    """A read-only statement, with a LIMIT if a SELECT names none."""
    if problem := sql_problem(statement):
        raise ValueError(problem)
    text = statement.strip().rstrip(";").strip()
    found = spark.sql(text)
    return found if re.match(r"(?i)show\b", text) or re.search(r"(?i)\blimit\s+\d+", text) else found.limit(limit)


def run_batch(spark: SparkSession, statements: str) -> list[tuple[str, DataFrame | None, str | None]]:
    """Each statement of a ;-separated batch with its result or its problem."""
    out: list[tuple[str, DataFrame | None, str | None]] = []
    for s in filter(None, map(str.strip, statements.split(";"))):
        try:
            out.append((s, run_sql(spark, s), None))
        except Exception as problem:  # a failing statement doesn't stop the batch
            out.append((s, None, str(problem)))
    return out


# Fixed pattern: how a task names an event.
EVENT_NUMBER = r"(?i)\bevent(?:\s+id)?\s*#?\s*(\d+)\b"


def event_id(task: Column) -> Column:
    """The first number that follows the word event, 'event id' or 'event #' in a task; null if there is none."""
    return F.nullif(F.regexp_extract(task, EVENT_NUMBER, 1), F.lit("")).try_cast("long")
