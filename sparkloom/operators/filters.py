"""Filters, lookups and small checks over requests, people and images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_status(df: DataFrame, column: str, status: str | None) -> DataFrame:
    """Rows of a status; all of them for none and for 'all'."""
    return df if not status or status == "all" else df.where(F.col(column) == status)


def mentions_any(text: str, *columns: Column) -> Column:
    """Whether one of the columns holds the text, in any case; a text without content is in all of them."""
    asked = text.strip().lower()
    found = F.lit(asked == "")
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(asked))
    return found


def full_name(first: str, last: str) -> Column:
    return F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(last, F.lit("")))


def ended(ends_at: Column, as_of: Column) -> Column:
    return F.coalesce(ends_at <= as_of, F.lit(False))


def may_work(eligibility: Column, active: Column, conduct: Column) -> Column:
    """An approved, active host who has accepted the code of conduct."""
    return F.coalesce((eligibility == "approved") & active & conduct, F.lit(False))


def events_of(events: DataFrame, apps: DataFrame, user: int) -> DataFrame:
    """Events that a user may see: as the client, as the leader, or having applied."""
    applied = apps.where(F.col("sender_id") == user).select("event_id").distinct().withColumn("applied", F.lit(True))
    rows = events.join(applied, "event_id", "left")
    return rows.where((F.col("client_id") == user) | (F.col("leader_id") == user) | F.col("applied")).drop("applied")


def led_events(events: DataFrame, apps: DataFrame, user: int) -> DataFrame:
    """Events led by a user: by the event's own column, or by an accepted application as team leader. Each once."""
    leads = apps.where((F.col("sender_id") == user) & (F.col("assigned_role") == "team_leader") & (F.col("status") == "accepted")).select("event_id", "app_id")
    return events.join(leads, "event_id", "left").where((F.col("leader_id") == user) | F.col("app_id").isNotNull()).drop("app_id").distinct()


def onboarding(users: DataFrame, step: str = "all") -> DataFrame:
    """Hosts that wait for the code of conduct ('awaiting_coc'), that have accepted it ('ready'), or all."""
    done = F.coalesce(F.col("conduct"), F.lit(False))
    return users.where(~done) if step == "awaiting_coc" else users.where(done) if step == "ready" else users


def venues_that_hold(venues: DataFrame, events: DataFrame, event_id: int) -> DataFrame:
    """Venues with room for the guests of one event; that event is one row, so its number goes to all tasks."""
    guests = events.where(F.col("event_id") == event_id).agg(F.max("guests").alias("asked"))
    return venues.crossJoin(F.broadcast(guests)).where(F.col("capacity") >= F.col("asked")).drop("asked")


def with_reports(records: DataFrame, key: str, **reports: DataFrame) -> DataFrame:
    """Records with a struct of each report by key; null where a report has none."""
    for name, report in reports.items():
        rest = [c for c in report.columns if c != key]
        records = records.join(report.select(key, F.struct(*rest).alias(name)), key, "left")
    return records


def chunks_by_page(chunks: DataFrame) -> DataFrame:
    """(file_name, page, chunk_id): a row for each page that a chunk spans."""
    return chunks.select("file_name", F.explode(F.sequence("page_start", "page_end")).alias("page"), "chunk_id")


def linked_chunks(contexts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, place, chunk_id, text): chunks that a query's images link, each once, in the order of their first link."""
    links = contexts.select("query_id", "rank", F.posexplode("linked").alias("at", "chunk_id"))
    first = links.groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", "at")).alias("place"))
    return first.join(chunks.select("chunk_id", "text"), "chunk_id").select("query_id", F.col("place.rank").alias("rank"), F.col("place.at").alias("at"), "chunk_id", "text")


def unique_images(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, image_id, score): of each image its best row, images without an id left out, the k best ranked anew."""
    from .retrieval import ranked

    best = rows.where(F.col("image_id").isNotNull()).groupBy("query_id", "image_id").agg(F.max("score").alias("score"))
    return ranked(best, k, ties=("image_id",))


def same_set(a: Column, b: Column) -> Column:
    """Whether two lists hold the same items, whatever their order."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def order_changed(a: Column, b: Column) -> Column:
    return same_set(a, b) & (a != b)


def missing_sources(expected: DataFrame, chunks: DataFrame, source: str) -> DataFrame:
    """Expected sources that no chunk comes from; empty if all are there."""
    return expected.select(source).distinct().join(chunks.select(source).distinct(), source, "left_anti")


def stored_ids(index: DataFrame, source: str, path: str, key: str = "point_id") -> DataFrame:
    """Ids that an index holds of one source."""
    return index.where(F.col(source) == path).select(key)


def image_sample(images: DataFrame, document: str | None = None, pages: Sequence[int] = (), text: str = "", n: int | None = None) -> DataFrame:
    """Images of a document, on one of the pages, with a text nearby or in their description; the first n by document and id."""
    if document:
        images = images.where(F.col("file_name") == document)
    if pages:
        images = images.where(F.arrays_overlap("pages", F.array(*map(F.lit, pages))))
    if text:
        images = images.where(mentions_any(text, F.col("nearby"), F.col("visual")))
    return images if n is None else images.orderBy("file_name", "image_id").limit(n)


# Fixed words of images that hold text.
TEXTISH = ("invitation", "menu", "card", "stationery", "sign", "program", "seating", "welcome", "text")


def ocr_sample(rows: DataFrame, mode: str, document: str | None = None) -> DataFrame:
    """(accepted, confidence, words, nearby, visual, section, file_name, ...) -> 'accepted' ones, rejected ones whose
    surroundings speak of text ('rejected_textish'), or one 'document'; `place` is by confidence and words, falling."""
    if mode == "accepted":
        rows = rows.where("accepted")
    elif mode == "rejected_textish":
        around = F.concat_ws(" ", "nearby", "visual", "section")
        rows = rows.where(~F.col("accepted") & around.rlike(f"(?i){'|'.join(TEXTISH)}"))
    elif mode == "document":
        rows = rows.where(F.col("file_name") == document)
    else:
        raise ValueError(f"unknown mode {mode}")
    return rows.orderBy(F.desc("confidence"), F.desc("words"))
