"""Further queries, each with its DuckDB SQL: operators on the driver's tables, or on views of them (given.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import guards
from ..operators import assembly, filters, images, issues, reports
from ..operators import evaluation as ev
from ..operators import relational as rel
from ..operators import retrieval as ret
from ..operators import scoring as sc
from ..operators import text as tx
from ..sources import tables
from ..sources.indexing import stale
from ..sources.tables import table
from . import queries as base
from .given import filled, frame
from .given import rows as values
from .sql import _STRIP, _any, _dense, _lexical

S, D = SparkSession, str
QUERIES: dict[str, Callable[[S, D], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RULES: dict[str, str] = {}  # SQL of queries over views, which tests also hold against hand-made rows


def held_against(sql: str | None):
    """Registers a query under its name, with the SQL that it is held against."""

    def add(query):
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = filled(sql)
            if ORACLES[query.__name__] != sql:
                RULES[query.__name__] = sql
        return query

    return add


def _csv(c) -> F.Column:
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")).cast("array<string>"), ",")


@held_against(f"""WITH m AS (SELECT id, coalesce({_STRIP('text')}, '') AS t FROM {values('messages')})
    SELECT id, CASE WHEN t = '' THEN 'empty' WHEN length(t) > 1000 THEN 'too_long' WHEN {_any('lower(t)', guards.INPUT_PATTERNS)} THEN 'injection' END AS input_reason,
    CASE WHEN t = '' THEN 'empty' WHEN {_any('t', [f'(?i){p}' for p in guards.OUTPUT_PATTERNS])} THEN 'sensitive' END AS output_reason FROM m""")
def guard_messages(spark: S, d: D) -> DataFrame:
    return frame(spark, d, "messages").select("id", guards.input_reason(F.col("text")).alias("input_reason"), guards.output_reason(F.col("text")).alias("output_reason"))


@held_against(f"SELECT id, CASE WHEN lower({_STRIP('status')}) IN ('accepted', 'rejected') THEN lower({_STRIP('status')}) ELSE 'pending' END AS key FROM {values('statuses')}")
def status_keys(spark: S, d: D) -> DataFrame:
    return frame(spark, d, "statuses").select("id", rel.status_key(F.col("status")).alias("key"))


_W = r"[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*"
_LET = lambda c: rf"regexp_replace({c}, '\P{{L}}', '', 'g')"


@held_against(rf"""WITH t AS (SELECT *, regexp_extract_all(text, '{_W}') AS w FROM {values('ocr')}),
    f AS (SELECT *, list_filter(w, lambda x: length({_LET('x')}) >= 2) AS m FROM t),
    g AS (SELECT *, len(list_filter(m, lambda x: length({_LET('x')}) >= 4 AND NOT regexp_matches({_LET('x')}, '[\x{{0400}}-\x{{052F}}\x{{0600}}-\x{{06FF}}]') AND regexp_matches(lower({_LET('x')}), '[{images.VOWELS}]'))) AS good,
        length({_LET('text')}) AS letters, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum FROM f),
    r AS (SELECT *, good / greatest(1, len(m)) AS cr, letters / greatest(1, alnum) AS ar, len(list_filter(w, lambda x: length(x) = 1)) / greatest(1, len(w)) AS sr,
        length(regexp_replace({_LET('text')}, '[\x{{0}}-\x{{24F}}]', '', 'g')) / greatest(1, letters) AS ur FROM g)
    SELECT id, len(m)::INTEGER AS meaningful, good::INTEGER AS coherent, round_even(cr, 4) AS coherent_ratio, round_even(ar, 4) AS alphabetic_ratio, round_even(sr, 4) AS single_ratio, round_even(ur, 4) AS unsupported_ratio,
    concat_ws(',', CASE WHEN length(text) < 6 THEN 'too_short' END, CASE WHEN conf IS NULL OR conf < 60 THEN 'low_mean_confidence' END, CASE WHEN len(m) < 3 THEN 'too_few_meaningful_words' END, CASE WHEN good < 4 THEN 'too_few_coherent_words' END,
        CASE WHEN cr < 0.45 THEN 'low_coherent_word_ratio' END, CASE WHEN ar < 0.65 THEN 'low_alphabetic_ratio' END, CASE WHEN sr > 0.30 THEN 'too_many_single_character_tokens' END, CASE WHEN ur > 0.10 THEN 'unsupported_script_noise' END) AS reasons FROM r""")
def ocr_quality(spark: S, d: D) -> DataFrame:
    rows = frame(spark, d, "ocr").select("id", images.ocr_quality(F.col("text"), F.col("conf")).alias("q")).select("id", "q.*")
    return rows.withColumn("reasons", F.array_join("reasons", ","))


@held_against(r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(replace(text, chr(12), ' '), '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\r\n|\n|\r'),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '[\p{L}\p{N}]')), chr(10)) AS text FROM documents""")
def ocr_cleaned(spark: S, d: D) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", images.clean_ocr(F.col("text")).alias("text"))


@held_against(r"""WITH l AS (SELECT id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM """ + values("headings") + r"""),
    w AS (SELECT *, regexp_replace(t, '\P{L}', '', 'g') AS letters, regexp_extract_all(t, '\p{L}+') AS ws, len(string_split(t, ' ')) AS n FROM l),
    g AS (SELECT *, list_filter(ws, lambda x: length(x) > 2) AS big FROM w)
    SELECT id, CASE WHEN t = '' OR length(t) > 180 OR n > 22 THEN NULL WHEN regexp_matches(t, '[.!?]$') AND n > 8 THEN NULL WHEN regexp_matches(t, '^(?:\d+(?:\.\d+)*[.)]?|[IVXLCDM]+[.)]|[A-Z][.)])\s+\S') THEN 1
        WHEN length(letters) > 0 AND length(regexp_replace(letters, '\P{Lu}', '', 'g')) / length(letters) >= 0.8 THEN 1
        WHEN len(ws) BETWEEN 4 AND 14 AND NOT regexp_matches(t, '[:|]') AND len(big) > 0 AND len(list_filter(big, lambda x: regexp_matches(x, '^\p{Lu}'))) / len(big) >= 0.6 THEN 2 END::INTEGER AS level,
    nullif(regexp_extract(text, '^\s*(\d+(?:\.\d+)*)[.)]?\s+', 1), '') AS section_number FROM g""")
def heading_levels(spark: S, d: D) -> DataFrame:
    return frame(spark, d, "headings").select("id", images.heading_level(F.col("text")).cast("int").alias("level"), images.section_number(F.col("text")).alias("section_number"))


@held_against(rf"""SELECT id, CASE WHEN trim(coalesce(label, '')) IN ('Arabic', 'English', 'French') THEN trim(label) WHEN starts_with(case_id, 'arabic_') OR regexp_matches(text, '[\x{{0600}}-\x{{06FF}}]') THEN 'Arabic'
    WHEN regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{tx.FRENCH_WORDS.replace(chr(39), chr(39) * 2)})(?:$|[^\p{{L}}\p{{N}}_])') OR regexp_matches(text, '[{tx.FRENCH_LETTERS}]') THEN 'French' ELSE 'English' END AS language FROM {values('queries')}""")
def case_languages(spark: S, d: D) -> DataFrame:
    return frame(spark, d, "queries").select("id", tx.query_language(F.col("text"), F.col("label"), F.col("case_id")).alias("language"))


@held_against(rf"""WITH l AS (SELECT *, trim(regexp_replace(text, '[ \t]+', ' ', 'g')) AS line FROM {values('page_lines')}), n AS (SELECT doc, count(DISTINCT page) AS n FROM l GROUP BY 1)
    SELECT doc, line AS text, count(DISTINCT page) AS pages FROM l JOIN n USING (doc) WHERE (y0 <= height * 0.18 OR y1 >= height * (1 - 0.18::DOUBLE)) AND length(line) BETWEEN 4 AND 120 GROUP BY doc, line, n HAVING count(DISTINCT page) >= greatest(2, round_even(n * 0.3, 0))""")
def boilerplate_bands(spark: S, d: D) -> DataFrame:
    return tx.repeated_lines(frame(spark, d, "page_lines"), "doc", "page", "text", 0.30, 0.18)


@held_against(f"""WITH i AS (SELECT doc, page, image_id, greatest(0, least(ix0, width)) AS ix0, greatest(0, least(iy0, height)) AS iy0, greatest(0, least(ix1, width)) AS ix1, greatest(0, least(iy1, height)) AS iy1, width, height FROM {values('images')}),
    j AS (SELECT *, greatest(least(iy1, y1) - greatest(iy0, y0), 0) / least(greatest(iy1 - iy0, 1), greatest(y1 - y0, 1)) AS v, greatest(least(ix1, x1) - greatest(ix0, x0), 0) / least(greatest(ix1 - ix0, 1), greatest(x1 - x0, 1)) AS h FROM i JOIN {values('blocks')} b USING (doc, page) WHERE NOT coalesce(boilerplate, false)),
    s AS (SELECT *, CASE WHEN v > 0.25 THEN 'beside' WHEN h > 0.25 AND y0 >= iy1 THEN 'below' WHEN h > 0.25 THEN 'above' ELSE 'diagonal' END AS relation,
        greatest(0, CASE WHEN v > 0.25 THEN greatest(x0 - ix1, ix0 - x1, 0) / width - 0.12 * v WHEN h > 0.25 THEN greatest(y0 - iy1, iy0 - y1, 0) / height + CASE WHEN y0 >= iy1 THEN 0.08 ELSE 0.12 END - 0.12 * h
            ELSE sqrt(power((x0 + x1 - ix0 - ix1) / 2 / width, 2) + power((y0 + y1 - iy0 - iy1) / 2 / height, 2)) + 0.25 END) AS far FROM j)
    SELECT image_id, row_number() OVER (PARTITION BY doc, image_id ORDER BY far, y0, x0, text)::INTEGER AS nth, relation, round(far, 6) AS distance, text FROM s QUALIFY nth <= 5""")
def image_neighbours(spark: S, d: D) -> DataFrame:
    return images.nearest_blocks(frame(spark, d, "images"), frame(spark, d, "blocks")).select("image_id", "nth", "relation", F.round("distance", 6).alias("distance"), "text")


# Filters


@held_against("SELECT 'F' AS asked, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'all', count(*) FROM orders")
def status_filter(spark: S, d: D) -> DataFrame:
    return filters.with_status(table(spark, d, "orders"), "o_orderstatus", "F").agg(F.lit("F").alias("asked"), F.count("*").alias("n")).unionByName(filters.with_status(table(spark, d, "orders"), "o_orderstatus", "all").agg(F.lit("all").alias("asked"), F.count("*").alias("n")))


@held_against("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_name || ' ' || p_type), 'e s')")
def like_search(spark: S, d: D) -> DataFrame:
    return table(spark, d, "part").where(filters.mentions_any("AN", F.col("p_name")) | filters.mentions_any("e S", F.concat_ws(" ", "p_name", "p_type"))).select("p_partkey")


@held_against("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-17 00:00:00'")
def ended_before(spark: S, d: D) -> DataFrame:
    return table(spark, d, "orders").where(filters.ended(F.col("o_orderdate"), F.lit("1995-06-17").cast("timestamp"))).select("o_orderkey")


@held_against(f"SELECT event_id FROM {values('events')} e WHERE client_id = 1 OR leader_id = 1 OR event_id IN (SELECT event_id FROM {values('apps')} WHERE sender_id = 1) UNION ALL SELECT 100 + event_id FROM {values('events')} WHERE client_id = 13 OR leader_id = 13 OR event_id IN (SELECT event_id FROM {values('apps')} WHERE sender_id = 13) UNION ALL SELECT 1000 + user_id FROM {values('users')} WHERE eligibility = 'approved' AND active AND conduct")
def row_access(spark: S, d: D) -> DataFrame:
    """Events of two users (the second's numbers from 100), and hosts who may work (from 1000)."""
    seen = lambda user, more: filters.events_of(frame(spark, d, "events"), frame(spark, d, "apps"), user).select((F.col("event_id") + more).alias("event_id"))
    hosts = frame(spark, d, "users").where(filters.may_work(F.col("eligibility"), F.col("active"), F.col("conduct"))).select((F.col("user_id") + 1000).alias("event_id"))
    return seen(1, 0).unionByName(seen(13, 100)).unionByName(hosts)


@held_against(f"SELECT user_id, coalesce(first, '') || ' ' || coalesce(last, '') AS name FROM {values('users')} WHERE contains(lower(coalesce(first, '') || ' ' || coalesce(last, '')), 'a s') OR contains(lower(coalesce(email, '')), 'a s') OR contains(lower(coalesce(phone, '')), 'a s') OR contains(lower(coalesce(email, '')), '@y') OR contains(phone, '71')")
def directory_search(spark: S, d: D) -> DataFrame:
    """Names, mails and phones, without the private columns."""
    name = filters.full_name("first", "last")
    hit = F.lit(False)
    for asked in (" a S ", "@Y", "71"):
        hit = hit | filters.mentions_any(asked, name, F.col("email"), F.col("phone"))
    return frame(spark, d, "users").where(hit).select("user_id", name.alias("name"))


@held_against(f"SELECT 'awaiting_coc' AS step, user_id FROM {values('users')} WHERE NOT coalesce(conduct, false) UNION ALL SELECT 'ready', user_id FROM {values('users')} WHERE conduct UNION ALL SELECT 'all', user_id FROM {values('users')}")
def onboarding_steps(spark: S, d: D) -> DataFrame:
    parts = [filters.onboarding(frame(spark, d, "users"), s).select(F.lit(s).alias("step"), "user_id") for s in ("awaiting_coc", "ready", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@held_against("SELECT DISTINCT n_regionkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR n_regionkey = 1")
def or_filter(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") | (F.col("n_regionkey") == 1)).select("n_regionkey", "c_mktsegment").distinct()


@held_against("SELECT p_partkey, p_size, p_type FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND p_size >= 25")
def capacity_in_city(spark: S, d: D) -> DataFrame:
    p = table(spark, d, "part")
    least = p.agg(F.min("p_type").alias("least"))  # one row
    return p.crossJoin(F.broadcast(least)).where((F.col("p_type") == F.col("least")) & (F.col("p_size") >= 25)).select("p_partkey", "p_size", "p_type")


# Joins and small aggregates


@held_against(f"SELECT DISTINCT e.event_id, e.title FROM {values('events')} e LEFT JOIN {values('apps')} a ON a.event_id = e.event_id AND a.sender_id = 12 AND a.assigned_role = 'team_leader' AND a.status = 'accepted' WHERE e.leader_id = 12 OR a.app_id IS NOT NULL")
def led_by(spark: S, d: D) -> DataFrame:
    return filters.led_events(frame(spark, d, "events"), frame(spark, d, "apps"), 12).select("event_id", "title")


@held_against(f"SELECT venue_id FROM {values('venues')} WHERE capacity >= (SELECT guests FROM {values('events')} WHERE event_id = 1)")
def roomy_venues(spark: S, d: D) -> DataFrame:
    return filters.venues_that_hold(frame(spark, d, "venues"), frame(spark, d, "events"), 1).select("venue_id")


@held_against("SELECT c_custkey, n.n AS orders, s.total AS price FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) n ON n.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) s ON s.o_custkey = c_custkey")
def merged_reports(spark: S, d: D) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    open_ = o.where("o_orderstatus = 'P'").groupBy("c_custkey").agg(F.count("*").alias("n"))
    urgent = o.where(F.col("o_orderpriority").startswith("1")).groupBy("c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return filters.with_reports(table(spark, d, "customer").select("c_custkey"), "c_custkey", weather=open_, route=urgent).select("c_custkey", F.col("weather.n").alias("orders"), F.col("route.total").alias("price"))


@held_against(f"SELECT file_name, unnest(range(page_start, page_end + 1))::INTEGER AS page, chunk_id FROM {values('chunks')}")
def page_chunks(spark: S, d: D) -> DataFrame:
    return filters.chunks_by_page(frame(spark, d, "chunks"))


_LINKS = f"(SELECT query_id, rank, c.chunk_id, min(nth) AS nth FROM (SELECT query_id, rank, unnest(linked) AS chunk_id, generate_subscripts(linked, 1) AS nth FROM {values('contexts')}) c GROUP BY ALL)"


@held_against(f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, place)::INTEGER AS nth, chunk_id, text FROM
    (SELECT query_id, chunk_id, rank, nth AS place, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, nth) AS n FROM {_LINKS}) JOIN {values('chunks')} USING (chunk_id) WHERE n = 1""")
def linked_texts(spark: S, d: D) -> DataFrame:
    return assembly.linked_texts(frame(spark, d, "contexts"), frame(spark, d, "chunks"))


@held_against(f"""WITH l AS (SELECT l.query_id, l.rank, string_agg(trim(text), chr(10) || chr(10) ORDER BY nth) AS linked_text FROM {_LINKS} l JOIN {values('chunks')} USING (chunk_id) WHERE trim(text) <> '' GROUP BY ALL)
    SELECT c.query_id, c.rank, trim(image_id) AS image_id, CASE WHEN trim(image_id) <> '' THEN 'http://h/media/' || trim(image_id) END AS image_url, file_name, page, trim(coalesce(section, '')) AS section,
    trim(coalesce(nullif(heading, ''), nullif(section, ''), '')) AS heading, coalesce(linked_text, trim(coalesce(nullif(nearby, ''), nullif(local, ''), nullif(context, ''), ''))) AS doc_text, trim(coalesce(visual, '')) AS visual, trim(coalesce(nullif(local, ''), nullif(nearby, ''), '')) AS context
    FROM {values('contexts')} c LEFT JOIN l USING (query_id, rank) WHERE rank <= 5""")
def display_cards(spark: S, d: D) -> DataFrame:
    return assembly.display_cards(frame(spark, d, "contexts"), frame(spark, d, "chunks"), "http://h/")


@held_against(f"""WITH m AS (SELECT h.*, topic FROM {values('hits')} h JOIN {values('topics')} USING (file_name)), f AS (SELECT query_id, topic, min(attempt) AS attempt FROM m GROUP BY ALL)
    SELECT query_id, topic, attempt, rank, chunk_id, file_name FROM m JOIN f USING (query_id, topic, attempt)""")
def topic_hits(spark: S, d: D) -> DataFrame:
    return assembly.topic_hits(frame(spark, d, "hits"), frame(spark, d, "topics"))


@held_against("SELECT doc_id, CASE WHEN len(list_filter([" + ", ".join(f"'{h}'" for h in ret.VISUAL_HINTS) + "], lambda h: contains(lower(text), h))) > 0 THEN 'visual' ELSE 'text' END AS intent FROM documents")
def query_intent(spark: S, d: D) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", ret.keyword_intent(F.col("text")).alias("intent"))


@held_against(f"""WITH v AS (SELECT a.query, max(variants) AS more FROM {values('asked')} a LEFT JOIN {values('variants')} v ON v.query = a.query AND model = 'm' AND variant_count = 2 GROUP BY a.query),
    l AS (SELECT query, list_concat([query], list_transform(coalesce(more, []), lambda x: trim(x))) AS l FROM v)
    SELECT query, array_to_string(list_filter(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: x <> '')[1:3], ',') AS variants FROM l""")
def variant_lookup(spark: S, d: D) -> DataFrame:
    return ret.query_variants(frame(spark, d, "variants"), frame(spark, d, "asked"), "m", 2).select("query", F.array_join("variants", ",").alias("variants"))


_SHARE = r"round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]{2,}')), list_distinct(regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]{2,}')))) / len(list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]{2,}'))), 6)"


@held_against(f"""WITH {_lexical(30)}, near AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY abs(length(d.text) - length(b.text)), id) AS rank FROM lex JOIN documents d ON d.doc_id = lex.id JOIN benchmark b ON b.item_id = lex.query_id),
    f AS (SELECT query_id, id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score, min(l * 1000 + rank) AS first FROM (SELECT query_id, id, 0 AS l, rank FROM near UNION ALL SELECT query_id, id, 1, rank FROM lex) GROUP BY ALL),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS original_rank FROM f), s AS (SELECT c.query_id, c.id, c.original_rank, {_SHARE} AS reranker_score FROM c JOIN documents d ON d.doc_id = c.id JOIN benchmark b ON b.item_id = c.query_id WHERE original_rank <= 30)
    SELECT query_id, rank::INTEGER AS rank, id, original_rank::INTEGER AS original_rank, reranker_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, original_rank) AS rank FROM s) WHERE rank <= 5""")
def hybrid_reranked(spark: S, d: D) -> DataFrame:
    """A ranking by length stands for the dense one; the score is the share of the item's tokens that a text holds."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(ret.TOKEN), F.lit(0)))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), tokens("text").alias("dt"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), tokens("text").alias("qt"))
    score = lambda found: found.join(docs, "id").join(items, "query_id").withColumn("reranker_score", F.round(F.size(F.array_intersect("qt", "dt")) / F.size("qt"), 6))
    lexical = base._lexical(spark, d, 30)
    return ret.hybrid_reranked(base._by_length(spark, d, lexical), lexical, score, 5).select("query_id", "rank", "id", "original_rank", "reranker_score")


@held_against(f"""WITH {_dense(64, 30, 'a')}, {_dense(32, 30, 'b')}, f AS (SELECT query_id, id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score, min(l * 1000 + rank) AS first FROM (SELECT query_id, id, 0 AS l, rank FROM a UNION ALL SELECT query_id, id, 1, rank FROM b) GROUP BY ALL)
    SELECT query_id, rank::INTEGER AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM f) WHERE rank <= 5""")
def hybrid_dense(spark: S, d: D) -> DataFrame:
    arm = lambda n: ret.dense_topk(base._halves(spark, d, n), base._corpus(spark, d, n), 30, True)
    return ret.hybrid(arm(64), arm(32), 5).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@held_against(f"WITH {_dense(64, 3, 'a', own=False)} SELECT 'dense' AS method, query_id, rank::INTEGER AS rank, id, round(score, 6) AS score FROM a")
def image_method(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("section"), F.slice("embedding", 1, 32).alias("stage1"), F.col("embedding").alias("full"))
    found = assembly.image_search(rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "id"), "dense", 3)
    return found.select("method", "query_id", "rank", "id", F.round("score", 6).alias("score"))


@held_against("SELECT label AS query_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, image_id)::INTEGER AS rank, image_id, score FROM (SELECT label, vec_id % 7 AS image_id, max(round(embedding[1]::DOUBLE, 6)) AS score FROM embeddings GROUP BY ALL) QUALIFY rank <= 3")
def unique_images(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("label").alias("query_id"), (F.col("vec_id") % 7).alias("image_id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))
    return filters.unique_images(rows, 3)


# Texts


_UNIQUE = f"""p AS (SELECT id, list_filter(list_transform(texts, lambda x: trim(regexp_replace(coalesce(x, ''), '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM {values('parts')}), u AS (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS u FROM p)"""
_JOINED = lambda most: f"array_to_string(u[1:len(list_filter(range(1, len(u) + 1), lambda i: list_sum(list_transform(u[1:i], lambda x: length(x))) + 2 * (i - 1) <= {most}))], chr(10) || chr(10))"
_END = r"""(.*[.!?](?:["'')\]]+)?)"""


@held_against(rf"""WITH {_UNIQUE}, w AS (SELECT id, u, array_to_string(u, ' ') AS w FROM u), s AS (SELECT *, regexp_extract(w[1:61], '^{_END}(?:\s|$)', 1, 's') AS s1, regexp_extract(w[1:60], '^{_END}(?:\s)', 1, 's') AS s2, regexp_extract(w[1:60], '^(.*\S)\s', 1, 's') AS cut FROM w),
    e AS (SELECT *, CASE WHEN length(s1) <= 60 THEN s1 ELSE s2 END AS s FROM s)
    SELECT id, CASE WHEN length(w) <= 60 THEN w WHEN length(s) >= 40 THEN trim(s) WHEN cut <> '' THEN cut ELSE {_JOINED(60)} END AS brief FROM e""")
def brief_contexts(spark: S, d: D) -> DataFrame:
    return frame(spark, d, "parts").select("id", assembly.brief_context(F.col("texts"), 60).alias("brief"))


@held_against(f"WITH {_UNIQUE} SELECT id, {_JOINED(120)} AS joined FROM u")
def joined_contexts(spark: S, d: D) -> DataFrame:
    return frame(spark, d, "parts").select("id", assembly.joined_texts(F.col("texts"), 120).alias("joined"))


_ON_LINE = lambda c: rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


@held_against(f"""WITH s AS (SELECT image_id, {_ON_LINE('document')} AS d, {_ON_LINE('heading')} AS h, {_ON_LINE('nearby')} AS n, {_ON_LINE('visual')} AS v FROM {values('stages')}),
    t AS (SELECT *, h || n || v <> '' AS has, CASE WHEN d <> '' THEN 'Document: ' || d END AS doc, CASE WHEN n <> '' THEN 'Description: ' || n END AS dn, CASE WHEN v <> '' THEN 'Visual description: ' || v END AS dv FROM s)
    SELECT image_id, CASE WHEN h <> '' THEN 'heading' WHEN n <> '' THEN 'nearby' WHEN v <> '' THEN 'vlm' END AS source1, CASE WHEN has THEN concat_ws(chr(10), doc, CASE WHEN h <> '' THEN 'Topic: ' || h WHEN n <> '' THEN dn ELSE dv END) END AS stage1,
    CASE WHEN h <> '' THEN concat_ws(chr(10), dn, dv) WHEN n <> '' THEN coalesce(dv, '') WHEN has THEN '' END AS stage2, CASE WHEN h <> '' AND n || v <> '' THEN 'nearby_vlm' WHEN h = '' AND n <> '' AND v <> '' THEN 'vlm' WHEN has THEN 'none' END AS source2 FROM t""")
def image_stages(spark: S, d: D) -> DataFrame:
    return frame(spark, d, "stages").select("image_id", assembly.stage_texts(*(F.col(c) for c in ("document", "heading", "nearby", "visual"))).alias("s")).select("image_id", "s.source1", "s.stage1", "s.stage2", "s.source2")


@held_against(f"SELECT page, CASE WHEN NOT coalesce(usable, false) THEN 'ocr' WHEN two_columns THEN 'native_layout_aware' ELSE 'native' END AS method FROM {values('extraction')}")
def extraction_methods(spark: S, d: D) -> DataFrame:
    return frame(spark, d, "extraction").select("page", assembly.extraction_method(F.col("usable"), F.col("two_columns")).alias("method"))


@held_against("SELECT p_partkey, CASE WHEN contains(lower(p_name), lower(p_type)) THEN p_name ELSE p_name || ' ' || p_type END AS description FROM part")
def venue_descriptions(spark: S, d: D) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.with_venue_type(F.col("p_name"), F.col("p_type")).alias("description"))


@held_against(rf"SELECT id, try_cast(nullif(regexp_extract(task, '(?i)\bevent(?:\s+id)?\s*#?\s*(\d+)\b', 1), '') AS BIGINT) AS event_id FROM {values('tasks')}")
def event_ids(spark: S, d: D) -> DataFrame:
    return frame(spark, d, "tasks").select("id", guards.event_id(F.col("task")).alias("event_id"))


# Reports and decisions


_ACC = f"(SELECT a.*, u.* FROM {values('apps')} a JOIN {values('users')} u ON user_id = sender_id WHERE status = 'accepted')"


@held_against(f"""SELECT e.event_id, count(h.app_id) AS accepted, greatest(coalesce(any_value(e.hosts), 0) - count(h.app_id), 0) AS shortage, count(*) FILTER (assigned_role = 'team_leader') > 0 AS has_leader, coalesce(string_agg(user_id::VARCHAR, ',' ORDER BY user_id) FILTER (needs_ride), '') AS rides,
    coalesce(string_agg(user_id::VARCHAR, ',' ORDER BY user_id) FILTER (NOT coalesce(active, false) AND user_id IS NOT NULL), '') AS inactive, coalesce(string_agg(user_id::VARCHAR, ',' ORDER BY user_id) FILTER (eligibility <> 'approved'), '') AS ineligible FROM {values('events')} e LEFT JOIN {_ACC} h ON h.event_id = e.event_id GROUP BY e.event_id""")
def staffing_reports(spark: S, d: D) -> DataFrame:
    out = reports.staffing_report(*(frame(spark, d, n) for n in ("events", "apps", "users")))
    return out.select("event_id", "accepted", "shortage", "has_leader", *(_csv(F.col(c)).alias(c) for c in ("rides", "inactive", "ineligible")))


@held_against(f"""WITH t AS (SELECT event_id, count(*) AS plans, sum(CASE WHEN passengers > 0 THEN passengers ELSE 4 END)::BIGINT AS seats FROM {values('trips')} GROUP BY 1), r AS (SELECT event_id, count(*) FILTER (needs_ride) AS rides FROM {_ACC} GROUP BY 1),
    a AS (SELECT e.event_id, e.clothes_id, h.size, count(*) AS asked FROM {_ACC} h JOIN {values('events')} e ON e.event_id = h.event_id WHERE request_dress AND h.size IS NOT NULL GROUP BY ALL),
    s AS (SELECT event_id, string_agg(a.size || ':' || (asked - coalesce(qty, 0)), ',' ORDER BY a.size) AS short FROM a LEFT JOIN {values('stock')} k ON k.clothes_id = a.clothes_id AND k.size = a.size WHERE asked > coalesce(qty, 0) GROUP BY 1)
    SELECT event_id, coalesce(capacity > 0 AND guests > capacity, false) AS over_capacity, coalesce(plans, 0) AS plans, coalesce(seats, 0) AS seats, coalesce(rides, 0) AS rides, coalesce(plans, 0) > 0 OR coalesce(rides, 0) > 0 AS planned, greatest(coalesce(rides, 0) - coalesce(seats, 0), 0) AS seats_short, coalesce(short, '') AS short
    FROM {values('events')} e LEFT JOIN {values('venues')} v USING (venue_id) LEFT JOIN t USING (event_id) LEFT JOIN r USING (event_id) LEFT JOIN s USING (event_id)""")
def logistics_reports(spark: S, d: D) -> DataFrame:
    return reports.logistics_report(*(frame(spark, d, n) for n in ("events", "venues", "trips", "apps", "users", "stock")))


@held_against(f"""WITH r AS (SELECT app_id, coalesce(request_dress, false) AS requested, nullif(u.size, '') AS size, c.clothes_id IS NOT NULL AS known, CASE WHEN c.clothes_id IS NOT NULL THEN k.qty END AS available
    FROM {values('apps')} a LEFT JOIN {values('users')} u ON user_id = sender_id LEFT JOIN {values('events')} e ON e.event_id = a.event_id LEFT JOIN {values('clothing')} c ON c.clothes_id = e.clothes_id LEFT JOIN {values('stock')} k ON k.clothes_id = e.clothes_id AND k.size = u.size)
    SELECT app_id, requested, size, available, coalesce(available > 0, false) AS is_available, CASE WHEN NOT requested THEN '' ELSE concat_ws('|', CASE WHEN NOT known THEN 'A clothing item was requested, but no event outfit was found.' END, CASE WHEN size IS NULL THEN 'Your clothing size is missing from your private host profile.' END, CASE WHEN available <= 0 THEN 'The required outfit is out of stock in size ' || size || '.' END) END AS risks,
    CASE WHEN NOT requested THEN '' ELSE concat_ws('|', CASE WHEN size IS NULL THEN 'Update your clothing size before confirming the outfit.' END, CASE WHEN available <= 0 THEN 'Contact the event administrator for an alternative outfit.' END, CASE WHEN available > 0 THEN 'Confirm reservation of size ' || size || '; snapshot stock is ' || available || '.' END) END AS advice FROM r""")
def outfit_reports(spark: S, d: D) -> DataFrame:
    out = reports.outfit_report(*(frame(spark, d, n) for n in ("apps", "users", "events", "clothing", "stock")))
    return out.select("app_id", "requested", "size", "available", "is_available", F.array_join("risks", "|").alias("risks"), F.array_join("advice", "|").alias("advice"))


@held_against(f"""SELECT app_id, CASE WHEN assigned_role = 'team_leader' THEN 'Attend the pre-event coordination briefing.' ELSE 'Attend the pre-event host briefing.' END AS first_duty, (3 + coalesce(needs_ride, false)::INT + coalesce(request_dress, false)::INT)::INTEGER AS steps,
    CASE WHEN request_dress THEN 'Confirm that the requested outfit is available.' WHEN needs_ride THEN 'Confirm your transportation pickup details.' ELSE 'Carry required identification.' END AS last_step FROM {values('apps')}""")
def assignment_lists(spark: S, d: D) -> DataFrame:
    return reports.assignments(frame(spark, d, "apps")).select("app_id", F.col("duties")[0].alias("first_duty"), F.size("checklist").alias("steps"), F.element_at("checklist", -1).alias("last_step"))


@held_against(f"""SELECT event_id, user_id, trim(concat_ws(' ', first, last)) AS name, user_id = 12 AS is_viewer, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(assigned_role <> 'team_leader', true), trim(concat_ws(' ', first, last)), user_id)::INTEGER AS place FROM {_ACC}""")
def team_cards(spark: S, d: D) -> DataFrame:
    return reports.team_cards(frame(spark, d, "apps"), frame(spark, d, "users"), 12).select("event_id", "user_id", "name", "is_viewer", "place")


@held_against(f"""WITH k AS (SELECT clothes_id, string_agg(size || ':' || qty, ', ' ORDER BY CASE size WHEN 'XS' THEN 1 WHEN 'S' THEN 2 WHEN 'M' THEN 3 WHEN 'L' THEN 4 WHEN 'XL' THEN 5 WHEN 'XXL' THEN 6 ELSE 7 END, size) AS stock FROM {values('stock')} GROUP BY 1),
    h AS (SELECT event_id, count(*) AS n, string_agg(trim(concat_ws(' ', first, last)), ',' ORDER BY trim(concat_ws(' ', first, last))) AS hosts FROM {_ACC} GROUP BY 1)
    SELECT e.event_id, v.name AS venue, c.label AS outfit, k.stock, coalesce(h.hosts, '') AS hosts, (1 + (v.venue_id IS NOT NULL)::INT + (c.clothes_id IS NOT NULL)::INT + coalesce(h.n, 0))::INTEGER AS source_count
    FROM {values('events')} e LEFT JOIN {values('venues')} v USING (venue_id) LEFT JOIN {values('clothing')} c USING (clothes_id) LEFT JOIN k USING (clothes_id) LEFT JOIN h USING (event_id)""")
def event_packs(spark: S, d: D) -> DataFrame:
    """The envelope's JSON is read again, so that what it holds is compared."""
    pack = reports.event_pack(*(frame(spark, d, n) for n in ("events", "venues", "clothing", "stock", "apps", "users")))
    shape = "venue struct<name: string>, outfit struct<label: string, stock: string>, hosts array<struct<name: string>>"
    return reports.envelope(pack, ["venue", "outfit", "hosts"]).withColumn("p", F.from_json("json", shape)).select(
        "event_id", "p.venue.name", F.col("p.outfit.label").alias("outfit"), F.col("p.outfit.stock").alias("stock"), F.array_join(F.transform("p.hosts", lambda h: h["name"]), ",").alias("hosts"), "source_count"
    ).withColumnRenamed("name", "venue")


@held_against(f"SELECT id, CASE label WHEN 'clothing' THEN 'inspect_event_clothing' WHEN 'transport' THEN 'inspect_event_transport' WHEN 'venue' THEN 'inspect_event_venue' WHEN 'staffing' THEN 'inspect_event_staffing' END AS tool FROM {values('labels')}")
def follow_ups(spark: S, d: D) -> DataFrame:
    return frame(spark, d, "labels").select("id", reports.follow_up(F.col("label")).alias("tool"))


@held_against(f"""SELECT e.event_id, e.title, c.label, v.name AS venue, capacity, (SELECT count(*) FROM {values('apps')} a WHERE a.event_id = e.event_id AND needs_ride) AS rides, (SELECT count(*) FROM {values('apps')} a WHERE a.event_id = e.event_id AND a.status = 'accepted') AS accepted,
    (SELECT count(*) FROM {values('trips')} t WHERE t.event_id = e.event_id) AS trips FROM {values('events')} e LEFT JOIN {values('venues')} v USING (venue_id) LEFT JOIN {values('clothing')} c USING (clothes_id)""")
def debriefs(spark: S, d: D) -> DataFrame:
    out = reports.debrief(*(frame(spark, d, n) for n in ("events", "venues", "clothing", "stock", "apps", "trips")))
    return out.select("event_id", "title", "label", "venue", "capacity", "rides", "accepted", "trips")


@held_against("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'accepted' ELSE 'rejected' END ELSE o_orderstatus END AS status, o_orderstatus <> 'P' AS refused FROM orders""")
def request_decisions(spark: S, d: D) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.col("o_orderstatus")).alias("status"))
    made = o.select("event_id", F.when(F.col("event_id") % 2 == 0, "accepted").otherwise("rejected").alias("decision"))
    return reports.decide_requests(o, made).withColumnRenamed("event_id", "o_orderkey")


@held_against(f"""WITH d AS (SELECT user_id, CASE WHEN user_id % 2 = 1 THEN 'approve' ELSE 'block' END AS said, u.* EXCLUDE user_id FROM {values('users')} u)
    SELECT user_id, CASE WHEN said = 'block' THEN 'blocked' WHEN conduct THEN 'approved' ELSE eligibility END AS eligibility, CASE WHEN said = 'block' THEN false WHEN conduct THEN true ELSE active END AS active, said = 'approve' AND NOT conduct AS refused FROM d""")
def host_decisions(spark: S, d: D) -> DataFrame:
    users = frame(spark, d, "users")
    return reports.decide_hosts(users, users.select("user_id", F.when(F.col("user_id") % 2 == 1, "approve").otherwise("block").alias("decision")))


@held_against("SELECT l_suppkey AS sender_id, l_orderkey AS event_id, EXISTS (SELECT 1 FROM lineitem o WHERE o.l_suppkey = n.l_suppkey AND o.l_orderkey = n.l_orderkey AND o.l_returnflag = 'R') AS duplicate FROM lineitem n WHERE l_returnflag = 'A'")
def duplicate_applications(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sender_id"), F.col("l_orderkey").alias("event_id"), "l_returnflag")
    return reports.new_applications(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'").drop("l_returnflag"))


@held_against(f"SELECT chat_id, CASE WHEN title = 'New chat' THEN substring(message, 1, 80) ELSE title END AS title FROM {values('chats')}")
def chat_titles(spark: S, d: D) -> DataFrame:
    return frame(spark, d, "chats").select("chat_id", reports.titled(F.col("title"), F.col("message")).alias("title"))


@held_against(f"""SELECT event_id, coalesce(nullif(title, ''), 'Untitled') AS title, CASE WHEN coalesce(type, '') = '' THEN 'General' ELSE array_to_string(list_transform(string_split(type, '_'), lambda x: upper(x[1]) || x[2:]), ' ') END AS category, coalesce(nullif(status, ''), 'pending') AS status,
    upper(coalesce(nullif(status, ''), 'pending')[1]) || coalesce(nullif(status, ''), 'pending')[2:] AS badge, coalesce(nullif(location, ''), 'Location TBA') AS place, coalesce(hosts, 0) AS hosts, coalesce(starts_at::DATE::VARCHAR, '') AS day FROM {values('events')}""")
def event_cards(spark: S, d: D) -> DataFrame:
    return reports.event_cards(frame(spark, d, "events"), rel.title_case)


@held_against(f"SELECT event_id, coalesce(c.label, CASE WHEN event_id % 2 = 0 THEN 'own' END) AS label, c.picture FROM {values('events')} LEFT JOIN {values('clothing')} c USING (clothes_id)")
def event_outfits(spark: S, d: D) -> DataFrame:
    rows = frame(spark, d, "events").withColumn("inline_label", F.when(F.col("event_id") % 2 == 0, "own"))
    return reports.with_outfit(rows, frame(spark, d, "clothing")).select("event_id", "outfit.label", "outfit.picture")


@held_against(f"SELECT id, CASE WHEN day < DATE '2025-01-02' THEN 'Completed' ELSE 'Upcoming' END AS status, CASE WHEN coalesce(starts, '') <> '' AND coalesce(ends, '') <> '' THEN starts[1:5] || ' - ' || ends[1:5] ELSE 'Time TBD' END AS duration FROM {values('requests')}")
def trainings(spark: S, d: D) -> DataFrame:
    return frame(spark, d, "requests").select("id", rel.training_status(F.col("day"), F.lit("2025-01-02").cast("date")).alias("status"), rel.training_duration(F.col("starts"), F.col("ends")).alias("duration"))


@held_against("SELECT event_id, lower(event_type) = 'click' OR event_id % 3 = 1 AS flag FROM events")
def flags(spark: S, d: D) -> DataFrame:
    v = F.when(F.col("event_type") == "click", "true").when(F.col("event_id") % 3 == 1, "1").when(F.col("event_id") % 3 == 2, "TRUE")
    return table(spark, d, "events").select("event_id", rel.flag(v).alias("flag"))


@held_against("SELECT event_id, user_id FROM events WHERE user_id::VARCHAR IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal > 0)")
def attendance(spark: S, d: D) -> DataFrame:
    return rel.current_attendance(table(spark, d, "events").select("event_id", "user_id"), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id")))


@held_against("SELECT vec_id, label FROM (SELECT *, (vec_id % 5)::INT AS p, 'Label ' || label AS nearby FROM embeddings) WHERE p IN (1, 3) AND contains(lower(nearby), 'label 2')")
def image_samples(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.array((F.col("vec_id") % 5).cast("int")).alias("pages"), F.concat(F.lit("Label "), F.col("label").cast("string")).alias("nearby"), F.lit(None).cast("string").alias("visual"))
    return filters.image_sample(rows, pages=(1, 3), text="LABEL 2").select("vec_id", "label")


@held_against("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND doc_id % 3 > 0")
def ocr_samples(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "n_chars", (F.col("lang") != "en").alias("accepted"), F.lit(1.0).alias("confidence"), F.col("n_chars").alias("words"), F.when(F.col("doc_id") % 3 == 1, "A MENU by the door").alias("nearby"), F.lit(None).cast("string").alias("visual"), F.when(F.col("doc_id") % 3 == 2, "Seating").otherwise("Roses").alias("section"))
    return filters.ocr_sample(rows, "rejected_textish").select("doc_id", "n_chars")


# Evaluation and checks


@held_against(f"""WITH g AS (SELECT *, unnest(['Overall', CASE mode WHEN 'text' THEN 'Text' ELSE 'Visual' END, CASE WHEN cross_language THEN 'Cross-language' END]) AS evaluated FROM {values('judged')})
    SELECT evaluated, count(*) AS cases, round(avg(router_ok::INT), 6) AS routing_accuracy, round(avg(faithful), 6) AS faithfulness, round(avg(correct), 6) AS correctness, round(avg(relevant), 6) AS relevance, round(avg(same_doc::INT), 6) AS same_doc_rate, round(avg(no_images::INT), 6) AS text_no_images_rate FROM g WHERE evaluated IS NOT NULL GROUP BY 1""")
def generation_report(spark: S, d: D) -> DataFrame:
    return ev.generation_report(frame(spark, d, "judged"))


@held_against("SELECT 'fixed_size' AS strategy, true AS nonempty_text, true AS unique_chunk_ids, true AS valid_page_numbers, true AS size_limit_respected UNION ALL SELECT 'recursive', true, true, true, true")
def chunk_checks(spark: S, d: D) -> DataFrame:
    parts = [base._chunks(spark, d, s).withColumn("strategy", F.lit(s)) for s in ("fixed_size", "recursive")]
    return ev.chunk_checks(parts[0].unionByName(parts[1]), "strategy", 800)


@held_against("SELECT event_type, round(avg(v), 6) AS mean, round(sum(v * event_id) / nullif(sum(CASE WHEN v IS NOT NULL THEN event_id END), 0), 6) AS weighted FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY 1")
def weighted_means(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 4 == 0, float("nan")).otherwise(F.col("value")).alias("v"), "event_id")
    return ev.weighted_mean(rows, ["event_type"], "v", "event_id")


@held_against("SELECT count(*) FILTER (l_quantity <= 2) AS low, sum(l_linenumber)::BIGINT AS total FROM lineitem")
def low_stock(spark: S, d: D) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count_if(F.col("l_quantity") <= 2).alias("low"), F.sum("l_linenumber").alias("total"))


@held_against("""WITH l AS (SELECT source, list(lang ORDER BY doc_id)[1:3] AS a, list(lang ORDER BY doc_id DESC)[1:3] AS b FROM documents GROUP BY 1)
    SELECT source, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS same, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AND a <> b AS changed FROM l""")
def list_changes(spark: S, d: D) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "lang")
    ends = []
    for name, order in (("a", F.col("doc_id")), ("b", F.desc("doc_id"))):
        nth = F.row_number().over(Window.partitionBy("source").orderBy(order))
        few = docs.withColumn("nth", nth).where("nth <= 3")  # three rows of a source, before they meet too
        ends.append(few.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "lang"))), lambda x: x["lang"]).alias(name)))
    return ends[0].join(ends[1], "source").select("source", filters.same_set(F.col("a"), F.col("b")).alias("same"), filters.order_changed(F.col("a"), F.col("b")).alias("changed"))


@held_against("SELECT source FROM documents GROUP BY 1 HAVING count(*) FILTER (length(text) < 400) = 0")
def missing_sources(spark: S, d: D) -> DataFrame:
    docs = table(spark, d, "documents")
    return filters.missing_sources(docs, docs.where(F.length("text") < 400), "source")


@held_against("SELECT doc_id AS point_id FROM documents WHERE source = (SELECT min(source) FROM documents)")
def scroll_ids(spark: S, d: D) -> DataFrame:
    docs = table(spark, d, "documents")
    first = docs.agg(F.min("source").alias("first"))  # one row
    rows = docs.crossJoin(F.broadcast(first)).select(F.col("doc_id").alias("point_id"), (F.col("source") == F.col("first")).cast("string").alias("mine"))
    return filters.stored_ids(rows, "mine", "true")


@held_against("SELECT d.doc_id AS point_id FROM documents d WHERE d.source IN (SELECT source FROM documents JOIN labels USING (doc_id)) AND d.doc_id NOT IN (SELECT doc_id FROM labels)")
def stale_rows(spark: S, d: D) -> DataFrame:
    """Rows of sources that came again, but not with them: what labels cover stands for what came."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("point_id"), "source")
    came = rows.join(table(spark, d, "labels").select(F.col("doc_id").alias("point_id")), "point_id", "left_semi")
    return stale(rows, came, "point_id", "source").select("point_id")


@held_against("SELECT n_name AS sheet FROM nation")
def sheet_names(spark: S, d: D) -> DataFrame:
    return table(spark, d, "nation").select(tables.sheet_name(F.concat(F.lit("["), F.col("n_name"), F.lit("]*"))).alias("sheet"))


@held_against("""SELECT event_id, CASE WHEN n IS NULL THEN 'unavailable' WHEN n > 16 THEN 'unavailable' WHEN n < 0 THEN 'historical' ELSE 'forecast' END AS horizon FROM (SELECT event_id, (event_id % 40) - 10 AS n FROM events)""")
def weather_horizons(spark: S, d: D) -> DataFrame:
    today = F.lit("2025-03-10").cast("date")
    return table(spark, d, "events").select("event_id", sc.weather_horizon(F.date_add(today, (F.col("event_id") % 40 - 10).cast("int")), today).alias("horizon"))


@held_against("SELECT c_custkey, c_acctbal / 50 BETWEEN -90 AND 90 AND c_acctbal / 25 BETWEEN -180 AND 180 AS valid FROM customer")
def route_checks(spark: S, d: D) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", sc.route_valid(F.col("c_acctbal") / 50, F.col("c_acctbal") / 25).alias("valid"))


@held_against("""SELECT p_partkey, TIMESTAMP '2025-05-01 18:00:00' - to_minutes(greatest(30, p_size)) AS arrival, TIMESTAMP '2025-05-01 18:00:00' - to_minutes(greatest(30, p_size) + 20) AS departure, greatest(1, ceil(p_size / 5))::BIGINT AS hosts FROM part""")
def host_timelines(spark: S, d: D) -> DataFrame:
    starts = F.lit("2025-05-01 18:00:00").cast("timestamp")
    arrives = sc.arrival(starts, F.concat(F.lit("Come "), F.col("p_size").cast("string"), F.lit(" Minutes before guest arrival, please")))
    return table(spark, d, "part").select("p_partkey", arrives.alias("arrival"), sc.departure(arrives, F.lit(20)).alias("departure"), sc.hosts_needed(F.col("p_size")).cast("long").alias("hosts"))


@held_against("""SELECT doc_id, len(list_filter(['en', 'de', 'xx'], lambda x: x = lang)) / 3 AS coverage, CASE WHEN lang = 'en' OR lang = 'de' THEN 1 ELSE 0 END::DOUBLE AS precision FROM documents""")
def list_metrics(spark: S, d: D) -> DataFrame:
    found, expected = F.array("lang"), F.array(F.lit("en"), F.lit("de"), F.lit("xx"))
    return table(spark, d, "documents").select("doc_id", ev.coverage(found, expected).alias("coverage"), ev.precision(found, expected).alias("precision"))


@held_against("""SELECT doc_id, lang IN ('en', 'fr') AND (doc_id % 3 = 1 OR contains(lower(text), 'market')) AS relevant, CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 = 1 ELSE contains(lower(text), 'market') END AS grounded FROM documents""")
def relevance_rules(spark: S, d: D) -> DataFrame:
    docs, pages, none, words = F.array(F.lit("en"), F.lit("fr")), F.array(F.lit("1")), F.array().cast("array<string>"), F.array(F.lit("Market"))
    page = (F.col("doc_id") % 3).cast("string")
    some = F.when(F.col("doc_id") % 2 == 0, pages).otherwise(none)
    return table(spark, d, "documents").select("doc_id", ev.relevant(F.col("lang"), page, F.lit(""), F.col("text"), docs, pages, none, words).alias("relevant"), ev.grounded(page, F.lit(""), F.col("text"), some, none, words).alias("grounded"))


@held_against("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'only the team leader reviews' WHEN o_orderdate > TIMESTAMP '1996-01-01' THEN 'the event has not ended' WHEN o_orderkey % 5 = 0 THEN 'already reviewed' WHEN o_orderkey % 8 NOT BETWEEN 1 AND 5 THEN 'stars from 1 to 5' END AS problem FROM orders""")
def review_problems(spark: S, d: D) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", rel.review_problem(k % 8, k % 7 != 0, F.col("o_orderdate"), k % 5 == 0, F.lit("1996-01-01").cast("timestamp")).alias("problem"))


@held_against("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a date and a time are needed' WHEN 1 THEN 'must be in the future' WHEN 2 THEN 'must start before it ends' END AS problem FROM events")
def request_problems(spark: S, d: D) -> DataFrame:
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % 4 + 1).cast("int"))
    starts, ends = pick("2025-02-01", "2024-01-01 10:00", "2025-02-01T10:00", "2025-02-01T10:00"), pick("2025-02-02 10:00", "2025-01-02 10:00", "2025-02-01T09:00", "2025-02-01 11:00")
    return table(spark, d, "events").select("event_id", rel.request_problem(starts, ends, F.lit("2025-01-01").cast("timestamp")).alias("problem"))


@held_against("SELECT event_id, CASE event_type WHEN 'click' THEN 'rag,sql_agent' WHEN 'view' THEN 'rag' ELSE 'sql_agent' END AS agents FROM events")
def router_plans(spark: S, d: D) -> DataFrame:
    say = lambda *xs: F.array(*map(F.lit, xs))
    plan = F.when(F.col("event_type") == "click", say("rag", "x", "rag", "sql_agent", "events")).when(F.col("event_type") == "view", say("rag", "rag")).otherwise(say("x"))
    return table(spark, d, "events").select("event_id", F.array_join(guards.routed(plan, ("rag", "sql_agent", "events")), ",").alias("agents"))


@held_against("SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR (doc_id % 5 = 1 AND doc_id % 3 = 2)")
def visible_reviews(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "public").otherwise("private").alias("visibility"), F.when(F.col("doc_id") % 5 == 1, F.col("doc_id") % 3).alias("reviewer_id"))
    return rel.visible_reviews(rows, 2, False).select("doc_id")


@held_against("SELECT doc_id, CASE WHEN length(text) > 280 THEN text[1:280] || '…' ELSE text END AS short, 'query: ' || lang AS prefixed FROM documents")
def source_texts(spark: S, d: D) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.truncated(F.col("text"), 280).alias("short"), ret.prefixed(F.col("lang"), "multilingual-E5", True).alias("prefixed"))


@held_against(None)
def issue_classifier(spark: S, d: D) -> DataFrame:
    """Trained on four fifths of the texts of each language, the language standing for the label; results on the rest."""
    rows = issues.stratified(table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label")), "label", "doc_id")
    return issues.classified(issues.fitted(rows.where("NOT test")), rows.where("test")).select("doc_id", "label", "predicted", "score")
