"""Relational building blocks: grouped statistics, overlaps, latest rows, fills, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_stats(parents: DataFrame, children: DataFrame, on: str, **aggregates: Column) -> DataFrame:
    """Parents with aggregates of their children, grouped before the join; null where there is no child."""
    return parents.join(children.groupBy(on).agg(*(c.alias(n) for n, c in aggregates.items())), on, "left")


def ordered_list(df: DataFrame, by: Sequence[str], item: Column, order: Sequence[Column], name: str, glue: str = ", ") -> DataFrame:
    """Items of each group joined to one string in a fixed order."""
    keys = [c.alias(f"o{i}") for i, c in enumerate(order)]
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, item.alias("item")))), lambda x: x["item"]), glue).alias(name))


def size_rank(size: Column, order: Sequence[str]) -> Column:
    """Position of a size in a fixed order; unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, order)), size)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def latest(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """The row of each group that is last by `order`; an aggregation, so a large group is combined before the shuffle."""
    rest = [c for c in df.columns if c != by]
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(order)]
    return df.groupBy(by).agg(F.max(F.struct(*keys, F.struct(*rest).alias("row"))).alias("m")).select(by, "m.row.*")


def overlaps(new: DataFrame, existing: DataFrame, key: str, bucket_days: int = 32, strict: bool = False) -> DataFrame:
    """Pairs (new_id, id) of the same key whose closed intervals meet; inputs have key, id, s, e as dates.

    Intervals are dealt to buckets of days, and a pair is made in the one bucket where the later start lies, so a
    key with many intervals is spread. Without `strict`, an existing interval must contain the start or the end
    of the new one; one that lies inside the new one is then no conflict.
    """
    def spread(df: DataFrame, i: str, s: str, e: str) -> DataFrame:
        day = lambda c: F.floor(F.unix_date(c) / bucket_days)
        return df.select(key, F.col("id").alias(i), F.col("s").alias(s), F.col("e").alias(e), F.explode(F.sequence(day(F.col("s")), day(F.col("e")))).alias("bucket"))

    pairs = spread(new, "new_id", "ns", "ne").join(spread(existing, "id", "s", "e"), [key, "bucket"]).where(
        (F.col("new_id") != F.col("id")) & (F.col("s") <= F.col("ne")) & (F.col("e") >= F.col("ns"))
        & (F.col("bucket") == F.floor(F.unix_date(F.greatest("s", "ns")) / bucket_days))
    )
    if not strict:
        pairs = pairs.where(F.col("ns").between(F.col("s"), F.col("e")) | F.col("ne").between(F.col("s"), F.col("e")))
    return pairs.select(key, "new_id", "id")


def candidate_fill(df: DataFrame, id_col: str, size_col: str, least: Column | int, current: int | None, n: int = 8) -> DataFrame:
    """Up to n candidates: the current one first, then the smallest that are large enough, then the largest of the rest."""
    least = F.lit(least) if isinstance(least, int) else least
    now = df.where(F.col(id_col) == current).withColumn("step", F.lit(0)).withColumn("o", F.lit(0).cast("double"))
    enough = df.where(F.col(size_col) >= least).orderBy(size_col, id_col).limit(n + 1).withColumn("step", F.lit(1)).withColumn("o", F.col(size_col).cast("double"))
    largest = df.orderBy(F.desc(size_col), id_col).limit(2 * n + 1).withColumn("step", F.lit(2)).withColumn("o", -F.col(size_col).cast("double"))
    rows = now.unionByName(enough).unionByName(largest)  # 3n + 3 rows at most
    first = rows.withColumn("seen", F.row_number().over(Window.partitionBy(id_col).orderBy("step"))).where("seen = 1")
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("step", "o", id_col))
    return first.withColumn("position", place).where(F.col("position") <= n).drop("seen", "step", "o")


def last_turns(conversations: DataFrame, n: int) -> DataFrame:
    """The last n rows of each conversation, and how many rows it has."""
    w = Window.partitionBy("conv_id")
    return conversations.withColumn("back", F.row_number().over(w.orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))).withColumn("size", F.count("*").over(w)).where(F.col("back") <= n)


def to_summarise(conversations: DataFrame, keep: int, trigger: int, after: int = -1) -> DataFrame:
    """User and assistant turns after `after`, without the last `keep`, of conversations of more than `trigger` rows."""
    w = Window.partitionBy("conv_id")
    rows = conversations.withColumn("back", F.row_number().over(w.orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))).withColumn("size", F.count("*").over(w))
    return rows.where((F.col("size") > trigger) & (F.col("back") > keep) & (F.col("turn") > after) & F.col("role").isin("user", "assistant")).drop("back", "size")


def upsert_stock(stock: DataFrame, delta: DataFrame, keys: Sequence[str], add: bool) -> DataFrame:
    """Stock after set (or add) of qty for each key of delta; keys new to the stock are inserted."""
    both = stock.withColumnRenamed("qty", "old").join(delta.withColumnRenamed("qty", "new"), list(keys), "full")
    qty = F.coalesce("old", F.lit(0)) + F.coalesce("new", F.lit(0)) if add else F.coalesce("new", "old")
    return both.select(*keys, qty.alias("qty"))


def guarded_decrement(stock: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, qty, rejected): quantities go down only where enough is there; requests without stock are rejected."""
    both = stock.join(wanted.withColumnRenamed("qty", "want"), list(keys), "full")
    enough = F.coalesce(F.col("qty") >= F.col("want"), F.lit(False))
    return both.select(*keys, F.when(enough, F.col("qty") - F.col("want")).otherwise(F.col("qty")).alias("qty"), (F.col("want").isNotNull() & ~enough).alias("rejected"))


def decide_applications(applications: DataFrame, approvals: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Applications after a batch of decisions (event_app_id, decision, role, as_of), with the reason of a refusal.

    Only pending ones can be decided; accepting is refused where `conflicts` holds the application's id.
    """
    joined = applications.join(approvals, "event_app_id", "left").join(conflicts.select("event_app_id").distinct().withColumn("conflict", F.lit(True)), "event_app_id", "left")
    reason = F.when(F.col("decision").isNull(), None).when(F.col("status") != "pending", "already decided").when(~F.col("decision").isin("accepted", "rejected"), "unknown decision").when((F.col("decision") == "accepted") & F.col("conflict"), "overlapping assignment")
    done = F.col("decision").isNotNull() & reason.isNull()
    return joined.select(
        *(c for c in applications.columns if c not in ("status", "assigned_role", "decided_at")),
        F.when(done, F.col("decision")).otherwise(F.col("status")).alias("status"),
        F.when(done & (F.col("decision") == "accepted"), F.coalesce("role", "requested_role", F.lit("host"))).otherwise(F.col("assigned_role")).alias("assigned_role"),
        F.when(done, F.col("as_of")).otherwise(F.col("decided_at")).alias("decided_at"),
        reason.alias("refused"),
    )


def review_problem(star: Column, is_leader: Column, ends_at: Column, reviewed: Column, as_of: Column) -> Column:
    """Why a review may not be written, or null."""
    return F.when(~F.coalesce(is_leader, F.lit(False)), "only the team leader reviews").when(ends_at > as_of, "the event has not ended").when(F.coalesce(reviewed, F.lit(False)), "already reviewed").when(star.isNull() | ~star.between(1, 5), "stars from 1 to 5")


def request_problem(starts: Column, ends: Column, as_of: Column) -> Column:
    """Why an event request's times (strings) are refused, or null."""
    s, e = (F.try_to_timestamp(c) for c in (starts, ends))
    timed = lambda c: c.rlike(r"[T ]\d{1,2}:\d{2}")
    return F.when(starts.isNull() | ends.isNull() | ~timed(starts) | ~timed(ends), "a date and a time are needed").when(s.isNull() | e.isNull(), "not a time").when(s <= as_of, "must be in the future").when(s >= e, "must start before it ends")


def visible_reviews(reviews: DataFrame, viewer: int | None, admin: bool) -> DataFrame:
    return reviews if admin else reviews.where((F.col("visibility") == "public") | (F.col("reviewer_id") == F.lit(viewer)))


def missing_and_union(required: Column, have: Column, more: Column) -> tuple[Column, Column]:
    """Sorted required items that are not there; and the ordered union of both lists without repeats."""
    return F.array_sort(F.array_except(required, have)), F.array_distinct(F.concat(have, more))


def title_case(text: Column) -> Column:
    """Words cut at spaces and underscores, first letters upper-case, the rest unchanged; 'General' if there are none."""
    parts = F.filter(F.split(text, r"[\s_]+"), lambda x: x != "")
    made = F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000))), " ")
    return F.when(F.size(parts) > 0, made).otherwise("General")


def status_key(status: Column) -> Column:
    """accepted or rejected, in any case and with blanks around; pending for all else and null."""
    low = F.lower(F.regexp_replace(status, r"(?U)^\s+|\s+$", ""))
    return F.when(low.isin("accepted", "rejected"), low).otherwise("pending")


def overlay(new: Column, old: Column) -> Column:
    """A looked-up value where it is not empty, else the old one."""
    return F.coalesce(F.nullif(F.trim(new), F.lit("")), old)


def flag(value: Column) -> Column:
    """True for true, 'true' in small letters, and what is the number 1; false for all else and null."""
    s = value.cast("string")
    number = s.rlike(r"^\s*\+?[0-9.]+([eE][+-]?[0-9]+)?\s*$")
    return F.coalesce((s == "true") | F.when(number, F.trim(F.regexp_replace(s, r"\s", " ")).try_cast("double") == 1), F.lit(False))


def training_status(day: Column, as_of: Column) -> Column:
    return F.when(day < as_of, "Completed").otherwise("Upcoming")


def training_duration(starts: Column, ends: Column) -> Column:
    """'hh:mm - hh:mm' of two times as strings."""
    there = (starts != "") & (ends != "")
    return F.when(there, F.concat(F.substring(starts, 1, 5), F.lit(" - "), F.substring(ends, 1, 5))).otherwise("Time TBD")


def current_attendance(attendance: DataFrame, hosts: DataFrame, key: str = "user_id") -> DataFrame:
    """Attendance entries of current hosts, ids compared as strings."""
    ids = hosts.select(F.col(key).cast("string").alias("_id"))
    return attendance.join(ids, F.col(key).cast("string") == F.col("_id"), "left_semi")
