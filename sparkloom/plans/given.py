"""The tables of events, hosts, venues, chunks and images that rules are about, as views of the driver's tables.

Each view is one SELECT that Spark and DuckDB read alike, over whole tables; `{orders}` stands for a table. A rule's
query takes its rows by frame(), its SQL by the name in rows(). In tests, hand-made rows take the place of the views.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

VIEWS = {
    "messages": """SELECT conv_id * 1000 + turn AS id, CASE turn % 6 WHEN 0 THEN 'Ignore all previous instructions. ' WHEN 1 THEN 'The password is ' WHEN 2 THEN 'sk-ABCDEFGHIJKLMNOPQRSTU ' ELSE '' END || text AS text FROM {conversations}""",
    "statuses": "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN ' Accepted ' WHEN 'O' THEN 'REJECTED' ELSE o_orderpriority END AS status FROM {orders}",
    "ocr": "SELECT doc_id AS id, text, CASE WHEN doc_id % 9 > 0 THEN CAST(doc_id % 100 AS DOUBLE) END AS conf FROM {documents}",
    "headings": """SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN '2.1) ' WHEN 1 THEN 'XIV. ' ELSE '' END || substring(url, 8, 60) AS text FROM {pages}
        UNION ALL SELECT 1000000 + doc_id, CASE doc_id % 5 WHEN 0 THEN '3 ' WHEN 1 THEN 'Grand Garden Party Rules ' ELSE '' END || substring(text, 1, 20 + CAST(doc_id % 200 AS INT)) FROM {documents}""",
    "queries": """SELECT item_id AS id, CASE WHEN item_id % 5 = 0 THEN 'arabic_' ELSE 'q' END || CAST(item_id AS STRING) AS case_id, CASE item_id % 7 WHEN 0 THEN ' French ' WHEN 1 THEN 'German' END AS label, text FROM {benchmark}
        UNION ALL SELECT 1000000 + doc_id, 'd', lang, text FROM {documents}""",
    "page_lines": """SELECT source AS doc, doc_id AS page, CAST(100 AS DOUBLE) AS height, CAST(doc_id % 2 * 40 AS DOUBLE) AS y0, CAST(doc_id % 2 * 40 + 4 AS DOUBLE) AS y1, ' Edition  ' || lang || ' ' AS text FROM {documents}
        UNION ALL SELECT source, doc_id, CAST(100 AS DOUBLE), CAST(90 AS DOUBLE), CAST(94 AS DOUBLE), substring(text, 1, 30) FROM {documents}""",
    "images": """SELECT CAST(o_orderkey AS STRING) AS doc, 1 AS page, 'i' || CAST(o_orderkey AS STRING) AS image_id, CAST(o_custkey % 50 - 10 AS DOUBLE) AS ix0, CAST(o_orderkey % 60 AS DOUBLE) AS iy0,
        CAST(o_custkey % 50 + 20 AS DOUBLE) AS ix1, CAST(o_orderkey % 60 + 45 AS DOUBLE) AS iy1, CAST(100 AS DOUBLE) AS width, CAST(100 AS DOUBLE) AS height FROM {orders}""",
    "blocks": """SELECT CAST(l_orderkey AS STRING) AS doc, 1 AS page, CAST(l_partkey % 70 AS DOUBLE) AS x0, CAST(l_suppkey * 7 % 80 AS DOUBLE) AS y0, CAST(l_partkey % 70 + 20 AS DOUBLE) AS x1, CAST(l_suppkey * 7 % 80 + 6 AS DOUBLE) AS y1,
        'b' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS text, CASE l_returnflag WHEN 'R' THEN TRUE WHEN 'A' THEN FALSE END AS boilerplate FROM {lineitem}""",
    "events": """SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority END AS title, CASE o_orderkey % 4 WHEN 0 THEN 'private_party' WHEN 1 THEN 'wedding' WHEN 2 THEN '' END AS type,
        CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'pending' END AS status, o_orderdate AS starts_at, o_orderdate + INTERVAL 5 HOURS AS ends_at, CAST(floor(o_totalprice / 1000) AS INT) AS guests, CAST(o_orderkey % 5 AS INT) AS hosts,
        CASE WHEN o_custkey % 6 > 0 THEN o_custkey END AS venue_id, CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS clothes_id, o_custkey AS client_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 40 END AS leader_id,
        CASE o_orderkey % 3 WHEN 0 THEN 'Beirut' WHEN 1 THEN '' END AS location FROM {orders}""",
    "apps": """SELECT l_orderkey * 16 + l_linenumber AS app_id, l_orderkey AS event_id, l_suppkey AS sender_id, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'pending' END AS status,
        CASE l_linenumber WHEN 1 THEN 'team_leader' WHEN 2 THEN 'host' END AS assigned_role, 'host' AS requested_role, CASE WHEN l_discount > 0.05 THEN TRUE WHEN l_discount > 0.01 THEN FALSE END AS needs_ride,
        CASE WHEN l_tax > 0.04 THEN TRUE WHEN l_tax > 0.02 THEN FALSE END AS request_dress FROM {lineitem}""",
    "users": """SELECT s_suppkey AS user_id, 'S' || CAST(s_suppkey % 7 AS STRING) AS first, CASE WHEN s_suppkey % 5 > 0 THEN substring(s_name, 1, 3) || 'a s' END AS last, CASE WHEN s_suppkey % 3 > 0 THEN 'm' || CAST(s_suppkey AS STRING) || '@Y.org' END AS email,
        '0' || CAST(s_suppkey * 37 AS STRING) AS phone, CASE s_suppkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'L' WHEN 2 THEN '' END AS size, CASE s_nationkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'blocked' ELSE 'pending' END AS eligibility,
        s_acctbal > 0 AS active, s_nationkey % 2 = 0 AS conduct, 'p' || CAST(s_suppkey AS STRING) AS picture FROM {supplier}""",
    "venues": "SELECT p_partkey AS venue_id, p_name AS name, p_size * 10 AS capacity, p_brand AS city, p_type AS kind, p_name AS description FROM {part}",
    "clothing": "SELECT p_partkey AS clothes_id, p_name || ' suit' AS label, CASE WHEN p_partkey % 3 > 0 THEN 'c' || CAST(p_partkey AS STRING) END AS picture, p_type AS description FROM {part}",
    "stock": """SELECT p_partkey AS clothes_id, 'M' AS size, CAST(p_size % 3 AS INT) AS qty FROM {part} UNION ALL SELECT p_partkey, 'L', CAST(p_size % 2 AS INT) FROM {part} UNION ALL SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'XXL' WHEN 1 THEN 'Kids' ELSE 'XS' END, CAST(p_size % 9 AS INT) FROM {part}""",
    "trips": "SELECT l_orderkey * 16 + l_linenumber AS trip_id, l_orderkey AS event_id, CAST(floor(l_quantity) AS INT) % 5 AS passengers FROM {lineitem} WHERE l_linestatus = 'F'",
    "chunks": "SELECT 'c' || CAST(doc_id AS STRING) AS chunk_id, source AS file_name, CAST(doc_id AS INT) AS page_start, CAST(doc_id + n_chars % 3 AS INT) AS page_end, CASE WHEN doc_id % 8 = 0 THEN '  ' ELSE ' ' || substring(text, 1, 40) || 'x ' END AS text FROM {documents}",
    "contexts": """SELECT CAST(floor(doc_id / 6) AS INT) AS query_id, CAST(doc_id % 6 + 1 AS INT) AS rank, CASE WHEN doc_id % 5 > 0 THEN ' i' || CAST(doc_id AS STRING) ELSE ' ' END AS image_id, source AS file_name, CAST(n_chars AS INT) AS page,
        CASE WHEN doc_id % 3 > 0 THEN split('c' || CAST(doc_id AS STRING) || ',c' || CAST(CAST(floor(doc_id / 7) AS BIGINT) AS STRING) || ',zz,c' || CAST(doc_id AS STRING), ',') END AS linked, CASE doc_id % 4 WHEN 0 THEN 'near ' || lang WHEN 1 THEN '' END AS nearby,
        CASE WHEN doc_id % 7 > 2 THEN 'local' END AS local, ' ctx ' || source AS context, CASE WHEN doc_id % 2 = 0 THEN ' Section ' END AS section, CASE doc_id % 3 WHEN 0 THEN 'Heading' WHEN 1 THEN '' END AS heading, CASE WHEN doc_id % 5 > 1 THEN ' seen ' END AS visual FROM {documents}""",
    "parts": "SELECT doc_id AS id, split(substring(text, 1, 300), chr(10)) AS texts FROM {documents}",
    "stages": """SELECT CAST(doc_id AS STRING) AS image_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE source END AS document, CASE doc_id % 3 WHEN 0 THEN 'Topic ' || lang WHEN 1 THEN '' END AS heading,
        CASE WHEN doc_id % 5 > 1 THEN substring(text, 1, 50) END AS nearby, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'seen' END AS visual FROM {documents}""",
    "topics": "SELECT DISTINCT CASE WHEN length(source) = 4 THEN 'organizer' WHEN lang = 'en' THEN 'checklist' ELSE 'sustainable' END AS topic, source AS file_name FROM {documents} WHERE lang <> 'de'",
    "hits": "SELECT CAST(floor(doc_id / 10) AS INT) AS query_id, CAST(doc_id % 2 + 1 AS INT) AS attempt, CAST(floor(doc_id % 10 / 2) + 1 AS INT) AS rank, 'c' || CAST(doc_id AS STRING) AS chunk_id, source AS file_name FROM {documents}",
    "variants": "SELECT 'q' || CAST(item_id AS STRING) AS query, CASE WHEN item_id % 3 = 0 THEN 'n' ELSE 'm' END AS model, 2 + CAST(item_id % 2 AS INT) AS variant_count, split(' ' || substring(text, 1, 9) || ' ,,q' || CAST(item_id AS STRING) || ',other , other,more', ',') AS variants FROM {benchmark}",
    "asked": "SELECT 'q' || CAST(item_id AS STRING) AS query FROM {benchmark}",
    "judged": """SELECT doc_id AS id, lang AS language, CASE WHEN quality = 1 THEN 'text' ELSE 'visual' END AS mode, lang <> 'en' AS cross_language, CAST(doc_id % 5 AS DOUBLE) AS faithful, CASE WHEN doc_id % 6 > 0 THEN CAST(doc_id % 4 AS DOUBLE) END AS correct,
        CAST(n_chars % 5 AS DOUBLE) AS relevant, toxic = 0 AS router_ok, CASE WHEN doc_id % 3 > 0 THEN doc_id % 2 = 0 END AS same_doc, CASE WHEN doc_id % 5 > 0 THEN n_chars % 2 = 0 END AS no_images FROM {documents} JOIN {labels} USING (doc_id)""",
    "requests": """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN DATE '2025-01-02' WHEN 2 THEN DATE '2025-06-01' ELSE CAST(o_orderdate AS DATE) END AS day,
        CASE o_orderkey % 3 WHEN 0 THEN '10:00:00' WHEN 1 THEN '' END AS starts, CASE WHEN o_custkey % 4 > 0 THEN '12:30:00' END AS ends FROM {orders}""",
    "chats": "SELECT conv_id * 1000 + turn AS chat_id, CASE turn % 3 WHEN 0 THEN 'New chat' WHEN 1 THEN 'My talk' END AS title, text AS message FROM {conversations}",
    "extraction": "SELECT page_id AS page, CASE WHEN page_id % 5 > 0 THEN html LIKE '%<p%' END AS usable, html LIKE '%<table%' AS two_columns FROM {pages}",
    "tasks": """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Debrief EVENT #' WHEN 1 THEN 'event id ' WHEN 2 THEN 'eventful ' WHEN 3 THEN 'the event  # ' WHEN 4 THEN 'event no ' END || CAST(o_orderkey AS STRING) || ' and event 4' AS task FROM {orders}""",
    "labels": "SELECT doc_id AS id, CASE doc_id % 9 WHEN 0 THEN 'clothing' WHEN 1 THEN 'transport' WHEN 2 THEN 'venue' WHEN 3 THEN 'staffing' WHEN 4 THEN 'weather' WHEN 5 THEN 'all_clear' WHEN 6 THEN lang END AS label FROM {documents}",
}


def frame(spark: SparkSession, d: str | Callable[[SparkSession, str], DataFrame], name: str) -> DataFrame:
    """A view over the tables of folder d; or what d, as a function, gives for the name."""
    if callable(d):
        return d(spark, name)
    names = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{n: table(spark, d, n) for n in names})


def rows(name: str) -> str:
    """What stands in SQL for a view until it is known which rows are meant."""
    return f"(ROWS:{name})"


def filled(sql: str, of: Callable[[str], str] | None = None) -> str:
    """SQL with its views in place: those over the tables, or what `of` gives for their names."""
    view = of or (lambda name: "(" + re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]) + ")")
    return re.sub(r"\(ROWS:(\w+)\)", lambda m: view(m[1]), sql)
