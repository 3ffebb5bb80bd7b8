"""Explainable scores as column expressions: readiness, weather, venues, routes, staffing, timelines, transport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _n(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def readiness(weather_risks: Column, shortage: Column, languages: Column, skills: Column, no_leader: Column, inactive: Column, ineligible: Column, guests: Column, capacity: Column, access_problem: Column, no_transport: Column, seats_short: Column, stock_short: Column, unsuitable: Column) -> Column:
    """struct(score, level, deductions array of (category, reason, points)): 100 less deductions, 0 at least.

    Numbers of weather risks, missing hosts, languages, skills, inactive and ineligible hosts are counts; the
    rest are conditions. Deductions keep the order of the arguments; those of no points are left out. The
    categories and reasons are fixed texts.
    """
    yes = lambda c, p: F.when(c, p).otherwise(0)
    each = (
        ("weather", F.concat(_n(weather_risks).cast("string"), F.lit(" weather risk(s) detected")), F.least(_n(weather_risks) * 8, F.lit(24))),
        ("staffing", F.concat(F.lit("Short by "), _n(shortage).cast("string"), F.lit(" host(s)")), F.least(_n(shortage) * 10, F.lit(30))),
        ("staffing", F.lit("Missing required languages"), F.least(_n(languages) * 8, F.lit(16))),
        ("staffing", F.lit("Missing required skills"), F.least(_n(skills) * 8, F.lit(16))),
        ("staffing", F.lit("No team leader assigned"), yes(no_leader, 10)),
        ("staffing", F.lit("Inactive hosts are assigned"), F.least(_n(inactive) * 10, F.lit(20))),
        ("staffing", F.lit("Ineligible hosts are assigned"), F.least(_n(ineligible) * 10, F.lit(20))),
        ("logistics", F.lit("Guest count exceeds venue capacity"), yes((capacity > 0) & (guests > capacity), 25)),
        ("logistics", F.lit("Accessibility requirement is not satisfied"), yes(access_problem, 20)),
        ("logistics", F.lit("Required transportation plan is missing"), yes(no_transport, 15)),
        ("logistics", F.lit("Transportation seats are insufficient"), yes(seats_short, 15)),
        ("logistics", F.lit("Clothing stock is insufficient"), yes(stock_short, 15)),
        ("logistics", F.lit("Clothing is unsuitable for the event type"), yes(unsuitable, 10)),
    )
    all_of = F.array(*(F.struct(F.lit(c).alias("category"), r.alias("reason"), p.cast("int").alias("points")) for c, r, p in each))
    made = F.filter(all_of, lambda x: x["points"] > 0)
    score = F.greatest(F.lit(0), F.lit(100) - F.aggregate(made, F.lit(0), lambda a, x: a + x["points"]))
    level = F.when(score >= 85, "ready").when(score >= 60, "needs_attention").otherwise("high_risk")
    return F.struct(score.alias("score"), level.alias("level"), made.alias("deductions"))


def weather(rain_prob: Column, rain_mm: Column, wind: Column, high: Column, low: Column, setting: Column, failed: Column) -> Column:
    """struct(score, risks): null score and one risk where the service failed; cold is a risk without deduction."""
    rain, windy, hot, cold = (rain_prob >= 60) | (rain_mm >= 5), wind >= 35, high >= 34, low <= 5
    rain, windy, hot, cold = (F.coalesce(c, F.lit(False)) for c in (rain, windy, hot, cold))
    outdoor = F.lower(F.coalesce(setting, F.lit("")))
    by = lambda o, m, e: F.when(outdoor == "outdoor", o).when(outdoor == "mixed", m).otherwise(e)
    less = F.when(rain, by(40, 20, 5)).otherwise(0) + F.when(windy, by(25, 25, 5)).otherwise(0) + F.when(hot, by(20, 20, 5)).otherwise(0)
    risks = F.array_compact(F.array(F.when(rain, "rain"), F.when(windy, "wind"), F.when(hot, "heat"), F.when(cold, "cold")))
    return F.struct(F.when(~failed, F.greatest(F.lit(0), 100 - less)).alias("score"), F.when(failed, F.array(F.lit("unavailable"))).otherwise(risks).alias("risks"))


def weather_horizon(day: Column, today: Column) -> Column:
    return F.when(F.datediff(day, today) > 16, "unavailable").when(day < today, "historical").otherwise("forecast")


def route_band(minutes: Column) -> Column:
    return F.when(minutes.isNull(), 0).when(minutes <= 5, 100).when(minutes <= 15, 80).when(minutes <= 30, 60).when(minutes <= 50, 40).otherwise(20)


def route_valid(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def route_units(metres: Column, seconds: Column) -> tuple[Column, Column]:
    return F.bround(metres / 1000, 1), F.bround(seconds / 60, 0).cast("int")


def venue_match(capacity: Column, guests: Column, accessible: Column, need_access: Column, parking: Column, description: Column, kind: Column, setting: Column) -> Column:
    """struct(score, eligible, capacity, accessibility, parking, event_type_fit, setting_resilience, percents, risks).

    Capacity gives 30 points, accessibility 25 (where not needed too), parking 15, an event type that the
    description names 20, an indoor or mixed setting 10 and any other 7. Percents are of each part's most points,
    halves to even. Eligible venues hold the guests and are accessible where that is needed. Risk texts are fixed.
    """
    room, asked = _n(capacity.cast("int")), _n(guests.cast("int"))
    needs, opens = F.coalesce(need_access, F.lit(False)), F.coalesce(accessible, F.lit(False))
    park, kind = F.coalesce(parking, F.lit(False)), F.lower(F.coalesce(kind, F.lit("")))
    fits, access = room >= asked, ~needs | opens
    typed = (kind != "") & F.contains(F.lower(F.coalesce(description, F.lit(""))), kind)
    inside = F.coalesce(setting.isin("indoor", "mixed"), F.lit(False))
    parts = {"capacity": (F.when(fits, 30).otherwise(0), 30), "accessibility": (F.when(access, 25).otherwise(0), 25), "parking": (F.when(park, 15).otherwise(0), 15),
             "event_type_fit": (F.when(typed, 20).otherwise(0), 20), "setting_resilience": (F.when(inside, 10).otherwise(7), 10)}
    risks = F.array_compact(F.array(
        F.when(~fits, F.concat(F.lit("Capacity is "), room.cast("string"), F.lit(", below the required "), asked.cast("string"), F.lit(" guests."))),
        F.when(~access, "The event requires accessibility, but this venue is not wheelchair accessible."),
        F.when(~park, "Venue parking is unavailable."),
    ))
    score = sum((p for p, _ in parts.values()), F.lit(0))
    percents = F.array(*(F.bround(p * 100 / most, 0).cast("int") for p, most in parts.values()))
    return F.struct(score.alias("score"), (fits & access).alias("eligible"), *(p.alias(n) for n, (p, _) in parts.items()), percents.alias("percents"), risks.alias("risks"))


def weighted_venue(suitability: Column, weather_score: Column, route_score: Column) -> Column:
    """0.70, 0.15 and 0.15 over the parts that are there, rounded half to even."""
    parts = ((suitability, 0.70), (weather_score, 0.15), (route_score, 0.15))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.bround(F.round(total / F.nullif(weight, F.lit(0.0)), 9), 0).cast("int")


def staffing(required: Column, accepted: Column, leader: Column, inactive: Column, ineligible: Column) -> Column:
    short = F.greatest(_n(required) - _n(accepted), F.lit(0))
    risks = F.array_compact(F.array(F.when(short > 0, "hosts missing"), F.when(leader.isNull(), "no team leader"), F.when(_n(inactive) > 0, "inactive hosts"), F.when(_n(ineligible) > 0, "hosts not approved")))
    return F.struct(short.alias("shortage"), leader.isNotNull().alias("has_leader"), risks.alias("risks"))


def transport(accepted: DataFrame, by: str) -> DataFrame:
    """accepted(by, needs_ride) -> needed and worst-case seats, and whether a smaller vehicle does (60 % of the worst case)."""
    out = accepted.groupBy(by).agg(F.count_if(F.coalesce(F.col("needs_ride"), F.lit(False))).alias("needed"), F.count("*").alias("worst"))
    return out.withColumn("downgrade", (F.col("worst") > 0) & (F.col("needed") <= F.floor(F.col("worst") * 0.6 + 0.5)))


def size_shortages(requests: DataFrame, stock: DataFrame) -> DataFrame:
    """(clothes_id, size) requests against (clothes_id, size, qty) -> clothes_id, shortages map of size to missing."""
    asked = requests.groupBy("clothes_id", "size").agg(F.count("*").alias("asked"))
    short = asked.join(stock, ["clothes_id", "size"], "left").withColumn("missing", F.col("asked") - F.coalesce("qty", F.lit(0))).where("missing > 0")
    return short.groupBy("clothes_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("size", "missing")))).alias("shortages"))


def arrival(starts: Column, instructions: Column) -> Column:
    """30 minutes before the start, or as many as the venue asks for before guests arrive, if more."""
    asked = F.regexp_extract(F.lower(F.coalesce(instructions, F.lit(""))), r"(\d+)\s+minutes?\s+before\s+guest\s+arrival", 1)
    minutes = F.greatest(F.lit(30), F.coalesce(asked.try_cast("int"), F.lit(30)))
    return starts - F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def departure(arrives: Column, travel_minutes: Column) -> Column:
    return arrives - F.make_dt_interval(F.lit(0), F.lit(0), travel_minutes)


def hosts_needed(guests: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(guests / 5))
