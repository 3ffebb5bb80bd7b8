"""Reports on one event or host each: staffing, logistics, outfits, assignments, teams, event packs, debriefs, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import ordered_list, size_rank

SIZES = ("XS", "S", "M", "L", "XL", "XXL")  # fixed order
SEATS = 4  # fixed: seats of a trip that names none


def _texts(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def staffing_report(events: DataFrame, apps: DataFrame, users: DataFrame) -> DataFrame:
    """A row for each event: accepted hosts, shortage, leader, hosts who need a ride, inactive and ineligible ones.

    A host whose activity isn't known is inactive; one who isn't approved is ineligible.
    """
    hosts = apps.where("status = 'accepted'").join(users, F.col("sender_id") == F.col("user_id"))
    of = lambda c: F.array_sort(F.array_compact(F.collect_list(F.when(c, F.col("user_id")))))
    per = hosts.groupBy("event_id").agg(
        F.count("*").alias("accepted"), F.max(F.when(F.col("assigned_role") == "team_leader", F.col("user_id"))).alias("leader"), of(F.col("needs_ride")).alias("rides"),
        of(~F.coalesce("active", F.lit(False))).alias("inactive"), of(F.col("eligibility") != "approved").alias("ineligible"),
    )
    none = F.array().cast("array<int>")
    rows = events.select("event_id", "hosts").join(per, "event_id", "left")
    return rows.select(
        "event_id", F.coalesce("accepted", F.lit(0).cast("long")).alias("accepted"), F.greatest(F.coalesce("hosts", F.lit(0)) - F.coalesce("accepted", F.lit(0).cast("long")), F.lit(0).cast("long")).alias("shortage"),
        F.col("leader").isNotNull().alias("has_leader"), *(F.coalesce(c, none).alias(c) for c in ("rides", "inactive", "ineligible")),
    )


def logistics_report(events: DataFrame, venues: DataFrame, trips: DataFrame, apps: DataFrame, users: DataFrame, stock: DataFrame) -> DataFrame:
    """A row for each event: guests against capacity, seats against rides, and sizes that are short.

    A trip that names no passengers counts as SEATS; transport is planned where there is a trip or a request for one.
    """
    seats = trips.groupBy("event_id").agg(F.count("*").alias("plans"), F.sum(F.when(F.col("passengers") > 0, F.col("passengers")).otherwise(SEATS)).alias("seats"))
    accepted = apps.where("status = 'accepted'")
    rides = accepted.groupBy("event_id").agg(F.count_if("needs_ride").alias("rides"))
    asked = accepted.where("request_dress").join(users, F.col("sender_id") == F.col("user_id")).join(events.select("event_id", "clothes_id"), "event_id").where("size IS NOT NULL").groupBy("event_id", "clothes_id", "size").agg(F.count("*").alias("asked"))
    short = asked.join(stock, ["clothes_id", "size"], "left").where(F.col("asked") > F.coalesce("qty", F.lit(0))).groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "size", (F.col("asked") - F.coalesce("qty", F.lit(0))).cast("string")))), ",").alias("short"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rows = events.select("event_id", "guests", "venue_id").join(venues.select("venue_id", "capacity"), "venue_id", "left").join(seats, "event_id", "left").join(rides, "event_id", "left").join(short, "event_id", "left")
    return rows.select(
        "event_id", F.coalesce((F.col("capacity") > 0) & (F.col("guests") > F.col("capacity")), F.lit(False)).alias("over_capacity"), zero("plans").alias("plans"), zero("seats").alias("seats"), zero("rides").alias("rides"),
        ((zero("plans") > 0) | (zero("rides") > 0)).alias("planned"), F.greatest(zero("rides") - zero("seats"), F.lit(0).cast("long")).alias("seats_short"), F.coalesce("short", F.lit("")).alias("short"),
    )


def outfit_report(apps: DataFrame, users: DataFrame, events: DataFrame, clothing: DataFrame, stock: DataFrame) -> DataFrame:
    """For each application: the host's size, what is left of the event's outfit in it, risks and advice (fixed texts)."""
    rows = (
        apps.select("app_id", "event_id", "sender_id", F.coalesce("request_dress", F.lit(False)).alias("asked")).join(users.select(F.col("user_id").alias("sender_id"), F.nullif("size", F.lit("")).alias("size")), "sender_id", "left")
        .join(events.select("event_id", "clothes_id"), "event_id", "left").join(clothing.select("clothes_id", F.lit(True).alias("known")), "clothes_id", "left").join(stock, ["clothes_id", "size"], "left")
    )
    asked, left = F.col("asked"), F.when(F.col("known"), F.col("qty"))
    risks = _texts(
        F.when(asked & F.col("known").isNull(), "A clothing item was requested, but no event outfit was found."),
        F.when(asked & F.col("size").isNull(), "Your clothing size is missing from your private host profile."),
        F.when(asked & (left <= 0), F.concat(F.lit("The required outfit is out of stock in size "), F.col("size"), F.lit("."))),
    )
    advice = _texts(
        F.when(asked & F.col("size").isNull(), "Update your clothing size before confirming the outfit."),
        F.when(asked & (left <= 0), "Contact the event administrator for an alternative outfit."),
        F.when(asked & (left > 0), F.concat(F.lit("Confirm reservation of size "), F.col("size"), F.lit("; snapshot stock is "), left.cast("string"), F.lit("."))),
    )
    return rows.select("app_id", asked.alias("requested"), "size", left.alias("available"), F.coalesce(left > 0, F.lit(False)).alias("is_available"), risks.alias("risks"), advice.alias("advice"))


# Fixed texts of an assignment.
DUTIES = {
    "team_leader": ("Attend the pre-event coordination briefing.", "Confirm host attendance and task distribution.", "Escalate operational issues to the event administrator."),
    "host": ("Attend the pre-event host briefing.", "Follow the assigned guest-service responsibilities.", "Report operational issues to the team leader."),
}
CHECKLIST = ("Review the venue and event schedule.", "Confirm attendance before the event.", "Carry required identification.")


def assignments(apps: DataFrame) -> DataFrame:
    """For each application: duties of its role (a host's, where it has none of its own) and a checklist."""
    say = lambda texts: F.array(*map(F.lit, texts))
    duties = F.when(F.col("assigned_role") == "team_leader", say(DUTIES["team_leader"])).otherwise(say(DUTIES["host"]))
    extra = _texts(F.when(F.col("needs_ride"), "Confirm your transportation pickup details."), F.when(F.col("request_dress"), "Confirm that the requested outfit is available."))
    return apps.select("app_id", "event_id", "assigned_role", duties.alias("duties"), F.concat(say(CHECKLIST), extra).alias("checklist"))


def team_cards(apps: DataFrame, users: DataFrame, viewer: int) -> DataFrame:
    """Accepted hosts of each event without private columns; place 1, 2, ...: leaders first, then by name."""
    from pyspark.sql import Window

    name = F.trim(F.concat_ws(" ", "first", "last"))
    rows = apps.where("status = 'accepted'").join(users, F.col("sender_id") == F.col("user_id")).select("event_id", "user_id", name.alias("name"), "assigned_role", "picture", (F.col("user_id") == viewer).alias("is_viewer"))
    follows = F.coalesce(F.col("assigned_role") != "team_leader", F.lit(True))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy(follows, "name", "user_id")))


def stock_text(stock: DataFrame) -> DataFrame:
    """(clothes_id, stock): 'size:quantity' in the order of sizes."""
    return ordered_list(stock, ["clothes_id"], F.concat_ws(":", "size", F.col("qty").cast("string")), [size_rank(F.col("size"), SIZES), F.col("size")], "stock")


def event_pack(events: DataFrame, venues: DataFrame, clothing: DataFrame, stock: DataFrame, apps: DataFrame, users: DataFrame) -> DataFrame:
    """A row for each event: the event, its venue and outfit as structs (null where there is none), accepted hosts by name."""
    hosts = apps.where("status = 'accepted'").join(users, F.col("sender_id") == F.col("user_id")).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(F.trim(F.concat_ws(" ", "first", "last")).alias("name"), "assigned_role"))).alias("hosts"))
    outfit = clothing.join(stock_text(stock), "clothes_id", "left").select("clothes_id", F.struct("label", "stock").alias("outfit"))
    place = venues.select("venue_id", F.struct("name", "capacity", "city").alias("venue"))
    rows = events.withColumnRenamed("hosts", "wanted").join(place, "venue_id", "left").join(outfit, "clothes_id", "left").join(hosts, "event_id", "left")
    return rows.select("event_id", F.struct("title", "type", "guests").alias("event"), "venue", "outfit", F.coalesce("hosts", F.array().cast("array<struct<name: string, assigned_role: string>>")).alias("hosts"))


def envelope(pack: DataFrame, sources: list[str]) -> DataFrame:
    """(event_id, json, source_count): a pack as one JSON text, and 1 and how many of the sources are there: a list
    counts as its items."""
    lists = {f.name for f in pack.schema.fields if f.dataType.typeName() == "array"}
    count = sum((F.size(c) if c in lists else F.col(c).isNotNull().cast("int") for c in sources), F.lit(1))
    return pack.select("event_id", F.to_json(F.struct(*pack.columns)).alias("json"), count.alias("source_count"))


# Fixed: which inspection follows a kind of issue.
FOLLOW_UPS = {"clothing": "inspect_event_clothing", "transport": "inspect_event_transport", "venue": "inspect_event_venue", "staffing": "inspect_event_staffing"}


def follow_up(label: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in FOLLOW_UPS.items() for x in pair))[F.coalesce(label, F.lit(""))]


def debrief(events: DataFrame, venues: DataFrame, clothing: DataFrame, stock: DataFrame, apps: DataFrame, trips: DataFrame) -> DataFrame:
    """A row for each event: outfit and stock, rides and trips, accepted hosts, venue and its room."""
    counts = apps.groupBy("event_id").agg(F.count_if("needs_ride").alias("rides"), F.count_if(F.col("status") == "accepted").alias("accepted"))
    rows = (
        events.select("event_id", "title", "guests", "hosts", "venue_id", "clothes_id").join(venues.select("venue_id", F.col("name").alias("venue"), "capacity"), "venue_id", "left").join(clothing.select("clothes_id", "label"), "clothes_id", "left")
        .join(stock_text(stock), "clothes_id", "left").join(counts, "event_id", "left").join(trips.groupBy("event_id").agg(F.count("*").alias("trips")), "event_id", "left")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("event_id", "title", "label", "stock", "venue", "guests", "capacity", "hosts", zero("rides"), zero("accepted"), zero("trips"))


def decide_requests(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events after decisions (event_id, decision): only pending ones change; `refused` tells of the others."""
    rows = events.join(decisions, "event_id", "left")
    pending = F.coalesce(F.col("status") == "pending", F.lit(False))
    known = F.col("decision").isin("accepted", "rejected")
    return rows.select("event_id", F.when(pending & known, F.col("decision")).otherwise(F.col("status")).alias("status"), (F.col("decision").isNotNull() & ~(pending & F.coalesce(known, F.lit(False)))).alias("refused"))


def decide_hosts(users: DataFrame, decisions: DataFrame) -> DataFrame:
    """Hosts after 'approve' or 'block'; approval needs the code of conduct."""
    rows = users.join(decisions, "user_id", "left")
    conduct = F.coalesce(F.col("conduct"), F.lit(False))
    said = F.when((F.col("decision") == "approve") & conduct, "approved").when(F.col("decision") == "block", "blocked")
    return rows.select("user_id", F.coalesce(said, "eligibility").alias("eligibility"), F.when(said.isNotNull(), said == "approved").otherwise(F.col("active")).alias("active"), F.coalesce((F.col("decision") == "approve") & ~conduct, F.lit(False)).alias("refused"))


def new_applications(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New applications with `duplicate`: whether the sender has applied to the event already."""
    there = existing.select("sender_id", "event_id").distinct().withColumn("there", F.lit(True))
    return new.join(there, ["sender_id", "event_id"], "left").withColumn("duplicate", F.col("there").isNotNull()).drop("there")


def titled(title: Column, message: Column) -> Column:
    """A conversation's title: while it is 'New chat', the first 80 characters of the message."""
    return F.when(title == "New chat", F.substring(message, 1, 80)).otherwise(title)


def filled(value: Column, default: Column | str) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def event_cards(events: DataFrame, as_title) -> DataFrame:
    """Events as they are shown: empty texts take their defaults, numbers only where they are null."""
    status = filled(F.col("status"), "pending")
    return events.select(
        "event_id", filled(F.col("title"), "Untitled").alias("title"), as_title(F.coalesce("type", F.lit(""))).alias("category"), status.alias("status"), as_title(status).alias("badge"),
        filled(F.col("location"), "Location TBA").alias("place"), F.coalesce("hosts", F.lit(0)).alias("hosts"), F.coalesce(F.to_date("starts_at").cast("string"), F.lit("")).alias("day"),
    )


def with_outfit(events: DataFrame, clothing: DataFrame, inline: str = "inline_label") -> DataFrame:
    """Events with `outfit` (label, picture): the dictionary's entry, else the event's own column, else null."""
    known = clothing.select("clothes_id", F.struct("label", "picture").alias("entry"))
    own = F.when(F.length(F.coalesce(inline, F.lit(""))) > 0, F.struct(F.col(inline).alias("label"), F.lit(None).cast("string").alias("picture")))
    return events.join(known, "clothes_id", "left").withColumn("outfit", F.coalesce("entry", own)).drop("entry")
