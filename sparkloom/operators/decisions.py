"""A batch of decisions on applications, each taken as if one after the other.

What is accepted earlier in a batch can refuse what comes later: a host can't be at two events at a time, and clothes run
out. Both rules look back along one order, and each needs the other's outcome: a refusal for want of clothes leaves the
host free. But clothes of a kind run out once, at one place in the order: where its last piece goes. So all that hosts need
to know of stocks is one place for each kind. It is closed in from both sides, in turns: hosts tell which rows are free for
sure, and which may be; the place lies between that of as many of the latter as there are pieces, and of as many of the former.
A turn settles one kind at least, and all that hangs on fewer alternations of the two rules; it takes only what is not
settled yet, and the times of the hosts concerned. With all places known, one walk over all rows ends it, as one loop would.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


NOT_FREE, MAYBE, FREE, HELD, TAKEN = range(5)  # states of a row in the walk of a host


def _walk(strict: bool, columns: list[str]):
    """Rows by host and order, held first, with (host, starts, ends, state, early, late) -> the rows with a new state.

    States: HELD times are taken before the first row, TAKEN ones from their row on. Others become 0 where they meet a
    taken time, FREE where they meet none that is or may be taken, else MAYBE. A free row that is early (its stock lasts
    for sure) takes its time, one that is late (its stock is gone for sure) takes none, and others may take it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, taken, may = None, _Times(strict), _Times(strict)
        for batch in batches:
            whose, old, early, late = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("host", "state", "early", "late"))
            starts, ends = (batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False).tolist() for c in ("starts", "ends"))
            states = []
            for who, begin, end, state, soon, gone in zip(whose, starts, ends, old, early, late):
                if who != host:
                    host, taken, may = who, _Times(strict), _Times(strict)
                if state < HELD:
                    state = NOT_FREE if taken.met(begin, end) else MAYBE if may.times and may.met(begin, end) else FREE
                if state >= HELD or state == FREE and soon:
                    taken.add(begin, end)
                elif state != NOT_FREE and not gone:
                    may.add(begin, end)
                states.append(state)
            found = {c: batch.column(c) for c in columns} | {"state": pa.array(states, pa.int32())}
            yield pa.RecordBatch.from_arrays(list(found.values()), list(found))

    return run


class _Times:
    """Times of a host in the order of their starts, which may meet one another; the longest bounds how far back one reaches."""

    def __init__(self, strict: bool):
        self.times, self.most, self.strict = [], 0, strict

    def add(self, begin: int, end: int) -> None:
        insort(self.times, (begin, end))
        self.most = max(self.most, end - begin)

    def met(self, begin: int, end: int) -> bool:
        times, least = self.times, min(begin, end) - self.most
        for j in range(bisect_left(times, (max(begin, end) + 1,)) - 1, -1, -1):
            s, e = times[j]
            if s < least:
                return False
            if s <= begin <= e or s <= end <= e or self.strict and s <= end and e >= begin:
                return True
        return False


def _walked(line: DataFrame, strict: bool) -> DataFrame:
    """line(host, at, id, starts, ends, state, early, late, ...) with new states; early and late go."""
    columns = [c for c in line.columns if c not in ("early", "late")]
    ordered = line.repartition("host").sortWithinPartitions("host", F.col("state") != HELD, "at", "id")
    return ordered.mapInArrow(_walk(strict, columns), line.select(columns).schema)


def _nth(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows(key, at, id, state), which may all be free, and wanted(key, pieces) -> key, side, place of as many of the rows
    as there are pieces: side 'may' of all, 'sure' of the free ones. Counts by day tell the day, and only its rows are put
    in order, so that a window holds the days of a key, or the rows of a key and day."""
    rows = rows.withColumn("day", F.date_trunc("day", "at"))
    days = rows.groupBy("key", "day").agg(F.count("*").alias("may"), F.count_if(F.col("state") == FREE).alias("sure"))
    both = days.select("key", "day", F.expr("stack(2, 'may', may, 'sure', sure) AS (side, n)")).where("n > 0")
    upto = both.withColumn("upto", F.sum("n").over(Window.partitionBy("key", "side").orderBy("day"))).join(wanted, "key")
    edge = upto.where((F.col("upto") >= F.col("pieces")) & (F.col("upto") - F.col("n") < F.col("pieces"))).select("key", "day", "side", (F.col("pieces") - F.col("upto") + F.col("n")).alias("nth"))
    near = rows.join(edge, ["key", "day"]).where((F.col("side") == "may") | (F.col("state") == FREE))
    placed = near.withColumn("n", F.row_number().over(Window.partitionBy("key", "side").orderBy("at", "id"))).where("n = nth")
    return placed.select("key", "side", _place().alias("place"))


def _place():
    return F.struct(F.lit(0).alias("part"), F.col("at").cast("timestamp").alias("at"), F.col("id").alias("id"))


def _bound(part: int):
    """A place before all others (-1) or after them (1)."""
    return F.struct(F.lit(part).alias("part"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("long").alias("id"))


def _closer(bounds: DataFrame, rows: DataFrame) -> DataFrame:
    """bounds(key, pieces, low, high) after another look at rows(key, at, id, state): where the last piece goes at the earliest
    and the latest. Pieces are those left beside the settled rows, which lie at `low` or before; rows lie at `high` or before."""
    open_keys = bounds.where("low < high")
    found = _nth(rows, open_keys.select("key", "pieces")).groupBy("key").agg(*(F.max(F.when(F.col("side") == s, F.col("place"))).alias(s) for s in ("may", "sure")))
    both = bounds.join(found, "key", "left")
    low = F.greatest("low", F.coalesce("may", F.col("high")))
    high = F.greatest(low, F.coalesce("sure", F.col("high")))
    shut = F.col("low") >= F.col("high")
    return both.select("key", "pieces", F.when(shut, F.col("low")).otherwise(low).alias("low"), F.when(shut, F.col("high")).otherwise(high).alias("high"))


def _timely(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """rows(key, at, id, asks, ...) with `early`: there is stock for sure, or none is asked for, and `late`: there is none for sure."""
    joined = rows.join(bounds.select("key", "low", "high"), "key", "left")
    early = ~F.col("asks") | F.coalesce(_place() <= F.col("low"), F.lit(False))
    late = F.col("asks") & F.coalesce(_place() > F.col("high"), F.lit(True))  # of what is no stock at all, too
    return joined.withColumn("early", early).withColumn("late", late).drop("low", "high")


def _last_pieces(spark: SparkSession, line: DataFrame, loose: DataFrame, given: DataFrame, strict: bool, rounds: int) -> DataFrame:
    """key, low, high: where the last piece of a kind goes, low and high alike; before all rows where there is none, after all
    where some is left. line(host, at, id, starts, ends, key, asks, state) has hosts' times, loose(at, id, key, state) what
    asks for clothes without a time."""
    counted = ["key", "at", "id", "state"]
    start = given.select("key", F.col("qty").alias("pieces"), _bound(-1).alias("low"), F.when(F.col("qty") > 0, _bound(1)).otherwise(_bound(-1)).alias("high"))
    asked = line.where("asks AND key IS NOT NULL").select(*counted).unionByName(loose.select(*counted))
    bounds, n = kept(_closer(start, asked), "bounds"), 0
    while not bounds.where("low < high").isEmpty():
        if n >= rounds:
            raise RuntimeError(f"decisions still change after {rounds} turns")
        n += 1
        # what comes too late for its stock takes no time, and what is not free never will be
        walked = kept(_walked(_timely(line, bounds).where("NOT late"), strict), "walked")
        still = walked.where(F.col("state").isin(MAYBE, FREE))
        bounds = kept(_closer(bounds, still.where("asks").select(*counted).unionByName(loose.select(*counted))), "bounds")
        settle = lambda rows: _timely(rows, bounds).where("NOT late").withColumn("settled", (F.col("state") == FREE) & F.col("early"))
        left, free = settle(still), settle(loose.withColumn("asks", F.lit(True)))
        gone = left.where("settled AND asks").select("key").unionByName(free.where("settled").select("key")).groupBy("key").agg(F.count("*").alias("gone"))
        bounds = kept(bounds.join(gone, "key", "left").select("key", (F.col("pieces") - F.coalesce("gone", F.lit(0))).alias("pieces"), "low", "high"), "bounds")
        loose = free.where("NOT settled").select(*counted)
        hosts = left.where("NOT settled").select("host").distinct()
        now = left.withColumn("state", F.when(F.col("settled"), TAKEN).otherwise(F.col("state")).cast("int")).select(*line.columns)
        line = walked.where(F.col("state") >= HELD).unionByName(now).join(hosts, "host", "left_semi").select(*line.columns)
    return bounds


def decided(spark: SparkSession, applications: DataFrame, stock: DataFrame, strict: bool = False, rounds: int = 50) -> DataFrame:
    """applications(id, host, event, at, starts, ends, status, decision, requested_role, role, item, size, as_of) and
    stock(item, size, qty) -> the applications with status, assigned_role, decided_at, refused.

    Decisions are taken by `at` and then id. Only pending applications are decided, and only as 'accepted' or
    'rejected'. An acceptance is refused where the host has an accepted time, from before or from earlier in the batch,
    that holds the start or the end of this one (with `strict`, that meets it at all), ends included, or where clothes are
    asked for (item and size are there) and none are left.
    An accepted one gets the role that was given, or else the one that was asked for, in small letters. Ids are unique
    and, like `at`, never null; without a host, start or end there is no overlap; a null qty is none. Empty tables give
    an empty result. Raises where `rounds` turns don't end it, rather than give half a result.

    Hosts are streamed in order and not gathered: a task holds the accepted times of one host.
    """
    wanted = F.col("decision") == "accepted"
    given = stock.where("item IS NOT NULL AND size IS NOT NULL").groupBy("item", "size").agg(F.sum(F.coalesce("qty", F.lit(0))).alias("qty"))
    given = kept(given.withColumn("key", F.monotonically_increasing_id()), "stock")  # kept, so that numbers stay
    rows = applications.withColumn("reason", F.when(F.col("decision").isNull(), "").when(F.col("status") != "pending", "already decided").when(~F.col("decision").isin("accepted", "rejected"), "unknown decision"))
    open_ = F.coalesce(wanted & F.col("reason").isNull(), F.lit(False))
    timed = F.col("host").isNotNull() & F.col("starts").isNotNull() & F.col("ends").isNotNull()
    rows = rows.withColumn("open", open_).withColumn("held", F.coalesce(F.col("status") == "accepted", F.lit(False)) & timed)
    rows = rows.withColumn("asks", F.col("open") & F.col("item").isNotNull() & F.col("size").isNotNull()).withColumn("walks", timed & (F.col("open") | F.col("held")))
    role = F.lower(F.coalesce("role", "requested_role")).alias("role")
    rows = rows.join(given.select("item", "size", "key"), ["item", "size"], "left").withColumn("key", F.when(F.col("asks"), F.col("key")))
    rows = kept(rows.select("id", "host", "event", "at", "starts", "ends", "status", "decision", role, "as_of", "reason", "open", "held", "asks", "walks", "key"), "applications")
    state = F.when(F.col("held"), HELD).otherwise(MAYBE).cast("int").alias("state")
    line = rows.where("walks").select("host", "at", "id", "starts", "ends", "key", "asks", state)
    loose = rows.where("asks AND NOT walks AND key IS NOT NULL").select("at", "id", "key", F.lit(FREE).cast("int").alias("state"))
    last = _last_pieces(spark, line, loose, given, strict, rounds)
    known = _timely(rows, last)
    walked = _walked(known.where("walks").withColumn("late_", F.col("late")).withColumn("state", state), strict).withColumnRenamed("late_", "late")
    every = walked.unionByName(known.where("NOT walks").withColumn("state", F.lit(FREE).cast("int")).select(*walked.columns))
    refused = F.when(F.col("reason") != "", F.col("reason")).when(F.col("open") & (F.col("state") == NOT_FREE), "overlapping assignment").when(F.col("open") & F.col("late"), "insufficient stock")
    done = F.col("decision").isNotNull() & F.col("refused").isNull()
    return every.withColumn("refused", refused).select(
        "id", "host", "event", "at",
        F.when(done, F.col("decision")).otherwise(F.col("status")).alias("status"),
        F.when(done & wanted, F.col("role")).alias("assigned_role"),
        F.when(done, F.col("as_of")).alias("decided_at"),
        "refused",
    )


def leaders(decisions: DataFrame, role: str = "team_leader") -> DataFrame:
    """event, leader: the host of the last application of an event that this batch accepted in that role."""
    chosen = decisions.where((F.col("status") == "accepted") & F.col("decided_at").isNotNull() & (F.col("assigned_role") == role))
    return chosen.groupBy("event").agg(F.max(F.struct("at", "id", "host"))["host"].alias("leader"))


def stock_left(applications: DataFrame, decisions: DataFrame, stock: DataFrame) -> DataFrame:
    """item, size, qty after one piece went to each application that the batch accepted and that asked for it."""
    taken = applications.join(decisions.where("status = 'accepted' AND decided_at IS NOT NULL").select("id"), "id", "left_semi").groupBy("item", "size").agg(F.count("*").alias("taken"))
    return stock.join(taken, ["item", "size"], "left").select("item", "size", (F.coalesce("qty", F.lit(0)) - F.coalesce("taken", F.lit(0))).alias("qty"))
