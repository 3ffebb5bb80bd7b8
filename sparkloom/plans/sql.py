"""DuckDB SQL that each query is held against, written from the rules rather than from the plans."""

from __future__ import annotations

from ..functions.guards import INPUT_PATTERNS, OUTPUT_PATTERNS


def _dense(n: int, k: int, name: str, own: bool = True, where: str = "true", q: str = "embedding") -> str:
    vec = lambda a, e="embedding": f"list_transform({a}.{e}[1:{n}], lambda x: x::DOUBLE)"
    return f"""{name}_s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity({vec('q', q)}, {vec('c')}), 9) AS score
        FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND {where} {'AND q.vec_id <> c.vec_id' if own else ''}),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def _cases(n: int) -> str:
    return _dense(n, 5, f"d{n}") + f""", j{n} AS (SELECT d.query_id, o.label, d.rank, f.label = o.label AS relevant FROM d{n} d JOIN embeddings f ON f.vec_id = d.id JOIN embeddings o ON o.vec_id = d.query_id),
    p{n} AS (SELECT query_id, label, min(CASE WHEN relevant THEN rank END) AS first_rank, sum(CASE WHEN relevant THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (relevant) AS found FROM j{n} GROUP BY ALL),
    c{n} AS (SELECT query_id, label, first_rank, CASE WHEN found > 0 THEN dcg / list_sum(list_transform(range(1, (found + 1)::BIGINT), lambda r: 1 / log2(r + 1))) ELSE 0 END AS ndcg FROM p{n})"""


def _summary(source: str, by: str) -> str:
    hit = lambda k: f"round(avg(CASE WHEN first_rank <= {k} THEN 1.0 ELSE 0.0 END), 6)"
    return f"""SELECT {by}, count(*) AS cases, {hit(1)} AS recall_1, {hit(3)} AS recall_3, {hit(5)} AS recall_5, round(avg(CASE WHEN first_rank <= 5 THEN 1 / first_rank ELSE 0 END), 6) AS mrr_5,
        round(avg(ndcg), 6) AS ndcg_5, count(*) FILTER (first_rank IS NULL OR first_rank > 5) AS failures FROM {source} GROUP BY {by}"""


_TERMS = r"""tok AS (SELECT kind, id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark)),
    terms AS (SELECT kind, id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tok),
    cnt AS (SELECT kind, id, term, count(*) AS c FROM terms GROUP BY ALL),
    idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM cnt WHERE kind = 'd' GROUP BY term),
    raw AS (SELECT kind, id, term, (1 + ln(c)) * idf AS w FROM cnt JOIN idf USING (term)),
    wts AS (SELECT kind, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY kind, id)) AS weight FROM raw)"""


def _lexical(k: int) -> str:
    return _TERMS + f""", lex_s AS (SELECT q.id AS query_id, d.id AS id, round(sum(q.weight * d.weight), 9) AS score FROM wts q JOIN wts d USING (term) WHERE q.kind = 'q' AND d.kind = 'd' GROUP BY ALL HAVING round(sum(q.weight * d.weight), 9) > 0),
    lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex_s) WHERE rank <= {k})"""


_GATED = _dense(32, 15, "first", own=False) + """,
    full_q AS (SELECT vec_id AS query_id, list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN i % 2 = 1 THEN embedding[i]::DOUBLE ELSE -embedding[i]::DOUBLE END) AS v FROM embeddings WHERE vec_id % 100 = 0),
    every AS (SELECT query_id, c.vec_id AS id, c.label AS section, round(list_cosine_similarity(v, list_transform(c.embedding, lambda x: x::DOUBLE)), 9) AS score FROM full_q, embeddings c),
    anchor AS (SELECT query_id, section FROM (SELECT e.query_id, e.section, row_number() OVER (PARTITION BY e.query_id ORDER BY e.score DESC, e.id) AS n FROM every e JOIN first f ON f.query_id = e.query_id AND f.id = e.id) WHERE n = 1),
    gated AS (SELECT * FROM (SELECT e.query_id, e.id, e.score, row_number() OVER (PARTITION BY e.query_id ORDER BY e.score DESC, e.id) AS rank FROM every e JOIN anchor USING (query_id, section)) WHERE rank <= 5),
    dense AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM every) WHERE rank <= 5),
    best AS (SELECT query_id, max(score) AS confidence FROM gated GROUP BY 1)"""

_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _chunk(starts: str, piece: str, table: str) -> str:
    return f"""SELECT doc_id || '-p0001-c' || lpad((pos + 1)::VARCHAR, 3, '0') AS chunk_id, doc_id AS document_id, 1 AS page_number, (pos + 1)::INTEGER AS page_chunk_index, text, length(text) AS character_count,
        len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word_count
        FROM (SELECT doc_id, i AS pos, {_STRIP(piece)} AS text FROM (SELECT *, unnest({starts}) AS s, generate_subscripts({starts}, 1) - 1 AS i FROM {table})) WHERE text <> ''"""


_FIXED = _chunk("range(0, greatest(length(text) - 101, 0) + 1, 700)", "substring(text, (s + 1)::BIGINT, 800)", f"(SELECT doc_id, text FROM documents WHERE {_STRIP('text')} <> '')")
_UNITS = f"""(SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_STRIP('text')}, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP('x')}), lambda x: x <> '') AS u FROM documents WHERE {_STRIP('text')} <> '')"""
_ITV = "SELECT o_custkey AS custkey, o_orderkey AS id, o_orderdate::DATE AS s, o_orderdate::DATE + (o_orderkey % 50 + 5)::INTEGER AS e FROM orders"
_MEET = f"WITH i AS ({_ITV}) SELECT a.custkey, a.id AS new_id, b.id FROM i a JOIN i b ON a.custkey = b.custkey AND a.id <> b.id AND "
_STOCK = lambda f: f"SELECT l_partkey AS item, l_linestatus AS size, sum(l_quantity)::BIGINT AS qty FROM lineitem WHERE l_returnflag = '{f}' GROUP BY ALL"


def _any(column: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


ORACLES = {
    "dense_topk": f"WITH {_dense(64, 5, 'd')} SELECT query_id, rank::INTEGER AS rank, id, round(score, 6) AS score FROM d",
    "dense_filtered": f"WITH {_dense(64, 5, 'd', where='c.label IN (1, 3, 5)')} SELECT query_id, rank::INTEGER AS rank, id FROM d",
    "dense_label_eval": f"WITH {_cases(64)} {_summary('c64', 'label')}",
    "rank_pivot": f"""WITH {_cases(32)}, {_cases(64)} SELECT a.query_id, a.first_rank::INTEGER AS dims_32, b.first_rank::INTEGER AS dims_64,
        CASE WHEN coalesce(b.first_rank, 1000) < coalesce(a.first_rank, 1000) THEN 'better' WHEN coalesce(b.first_rank, 1000) > coalesce(a.first_rank, 1000) THEN 'worse' ELSE 'tied' END AS compared FROM c32 a JOIN c64 b USING (query_id)""",
    "method_select": f"""WITH {_cases(16)}, {_cases(32)}, {_cases(64)},
        every AS (SELECT 'dims_16' AS method, 16 AS latency, * FROM c16 UNION ALL SELECT 'dims_32', 32, * FROM c32 UNION ALL SELECT 'dims_64', 64, * FROM c64),
        s AS ({_summary('every', 'method, latency')}), f AS (SELECT method, min(recall_5) AS floor FROM ({_summary('every', 'method, label')}) GROUP BY 1)
        SELECT method, floor, recall_1, recall_5, mrr_5, (row_number() OVER (ORDER BY floor DESC, recall_5 DESC, mrr_5 DESC, recall_1 DESC, latency, method))::INTEGER AS place FROM s JOIN f USING (method)""",
    "multi_query_rrf": f"""WITH {_dense(64, 20, 'd', own=False)}, f AS (SELECT e.label, d.id, round(sum(1.0 / (60 + d.rank)), 9) AS score FROM d JOIN embeddings e ON e.vec_id = d.query_id GROUP BY ALL)
        SELECT label, rank::INTEGER AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 5""",
    "gated_images": f"""WITH {_GATED} SELECT r.query_id, r.rank::INTEGER AS rank, r.id, round(r.score, 6) AS score, b.confidence < 0.3 AS fallback_used, round(b.confidence, 6) AS confidence
        FROM (SELECT *, false AS dense FROM gated UNION ALL SELECT query_id, id, score, rank, true FROM dense) r JOIN best b USING (query_id) WHERE r.dense = (b.confidence < 0.3)""",
    "threshold_sweep": f"WITH {_GATED} SELECT t::DOUBLE AS threshold, round(avg((confidence < t)::INTEGER), 6) AS fallback_rate FROM best, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS t) GROUP BY t",
    "tfidf_index": f"WITH {_TERMS} SELECT id AS doc_id, term, round(weight, 6) AS weight FROM wts WHERE kind = 'd'",
    "tfidf_topk": f"WITH {_lexical(5)} SELECT query_id, rank::INTEGER AS rank, id, round(score, 6) AS score FROM lex",
    "rrf_fusion": f"""WITH {_lexical(30)}, len AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY abs(length(d.text) - length(b.text)), id) AS rank FROM lex JOIN documents d ON d.doc_id = lex.id JOIN benchmark b ON b.item_id = lex.query_id),
        parts AS (SELECT query_id, id, 0 AS l, rank FROM lex UNION ALL SELECT query_id, id, 1, rank FROM len),
        f AS (SELECT query_id, id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score, min(l * 1000 + rank) AS first FROM parts GROUP BY ALL)
        SELECT query_id, rank::INTEGER AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM f) WHERE rank <= 5""",
    "rerank_scored": rf"""WITH {_lexical(10)}, s AS (SELECT lex.query_id, lex.id, lex.rank AS original_rank, list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS q, list_distinct(regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS t FROM lex JOIN documents d ON d.doc_id = lex.id JOIN benchmark b ON b.item_id = lex.query_id),
        r AS (SELECT query_id, id, original_rank::INTEGER AS original_rank, round(len(list_intersect(q, t)) / len(q), 6) AS reranker_score FROM s)
        SELECT query_id, rank::INTEGER AS rank, id, original_rank, reranker_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, original_rank) AS rank FROM r) WHERE rank <= 5""",
    "theme_reorder": f"""WITH {_lexical(10)}, m AS (SELECT lex.*, d.source = 'src' || (lex.query_id % 20) AS matched FROM lex JOIN documents d ON d.doc_id = lex.id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN matched THEN 0 ELSE 1 END, score DESC, rank))::INTEGER AS rank, id, matched FROM m""",
    "clean_text": f"""WITH a AS (SELECT doc_id, text, regexp_replace(replace(text, chr(65533), ''), '(?:\\.\\s*){{4,}}', ' ', 'g') AS t FROM documents),
        b AS (SELECT doc_id, text, array_to_string(list_transform(string_split(t, chr(10)), lambda x: {_STRIP("regexp_replace(x, '[ \\t]+', ' ', 'g')")}), chr(10)) AS t FROM a)
        SELECT doc_id, {_STRIP("regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g')")} AS text, length({_STRIP('text')}) >= 10 AND length(regexp_replace({_STRIP('text')}, '[^\\x{{E000}}-\\x{{F8FF}}]', '', 'g')) < 0.05 * length({_STRIP('text')}) AS usable FROM b""",
    "chunk_fixed": _FIXED,
    "chunk_sentence": _chunk("range(0, greatest(len(u) - 2, 0) + 1, 3)", "array_to_string(u[s + 1 : s + 4], chr(10))", _UNITS),
    "chunk_stats": f"""WITH c AS ({_FIXED}) SELECT count(*) AS chunks, count(DISTINCT document_id) AS documents, min(character_count) AS least, quantile_cont(character_count, 0.5) AS median, round(avg(character_count), 4) AS mean, quantile_cont(character_count, 0.9) AS p90, max(character_count) AS most,
        count(*) FILTER (character_count < 100) AS short_chunks, round(100 * avg((character_count < 100)::INTEGER), 4) AS short_percent FROM c""",
    "boilerplate_lines": f"""WITH r AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents), n AS (SELECT source, count(DISTINCT doc_id) AS every FROM r GROUP BY 1),
        l AS (SELECT source, doc_id, {_STRIP("regexp_replace(regexp_replace(replace(raw, chr(65533), ''), '(?:\\.\\s*){4,}', ' ', 'g'), '[ \\t]+', ' ', 'g')")} AS line FROM r)
        SELECT source, line, count(DISTINCT doc_id) AS pages FROM l JOIN n USING (source) WHERE length(line) BETWEEN 4 AND 120 GROUP BY source, line, every HAVING count(DISTINCT doc_id) >= greatest(2, round_even(every * 0.02, 0))""",
    "doc_profile": """SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS std, min(n_chars) AS least, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3,
        max(n_chars) AS most, sum(n_chars)::BIGINT AS total, count(*) FILTER (n_chars < 200) AS short, count(DISTINCT source) AS sources FROM documents GROUP BY lang""",
    "query_language": r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{0600}-\x{06FF}]') THEN 'Arabic' WHEN regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:quelles?|qui|quel|qu''est-ce|dans quels|s''occupe|comprennent|prévoir|événementielle|organisateurs?)(?:$|[^\p{L}\p{N}_])')
        OR regexp_matches(text, '[àâäéèêëïîôùûüçÀÂÄÉÈÊËÎÏÔÙÛÜÇ]') THEN 'French' ELSE 'English' END AS language FROM documents""",
    "client_stats": "SELECT c_custkey, c_name, nullif(count(o_orderkey), 0) AS n_orders, max(o_orderdate) AS last_order, min(o_orderdate) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY ALL",
    "worked_clients": "SELECT o_custkey AS custkey, count(*) AS n, max(o_orderdate) FILTER (o_orderstatus = 'P') AS last_open, ((2 * sum(round(100 * o_totalprice)::BIGINT) + count(*)) // (2 * count(*)))::DOUBLE / 100 AS mean_price FROM orders GROUP BY 1",
    "enrolment_count": "SELECT p_partkey, count(l_orderkey) AS enrolled FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity >= 45 GROUP BY 1",
    "stock_concat": "SELECT l_suppkey, string_agg(l_returnflag || ':' || n, ', ' ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_returnflag) AS stock FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1",
    "star_left": """SELECT r_name, count(*) AS lines, count(o_orderkey) AS finished, round(sum(l_extendedprice), 2) AS price FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'
        LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    "customer_flags": "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_pending, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AS n_urgent FROM customer",
    "missing_anti": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "overlap_reference": _MEET + "(a.s BETWEEN b.s AND b.e OR a.e BETWEEN b.s AND b.e)",
    "overlap_strict": _MEET + "b.s <= a.e AND b.e >= a.s",
    "latest_per_key": "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "recent_window": "SELECT conv_id, turn, role, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations) WHERE n <= 3",
    "summarise_set": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations) WHERE n > 3 AND c > 4 AND role IN ('user', 'assistant')",
    "kpi_row": """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, greatest(count(*) - count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'P'), 0) AS rest,
        round(sum(greatest(60 - coalesce(q, 0), 0)), 2) AS shortage FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "candidate_fill": """WITH a AS (SELECT p_partkey, p_size, CASE WHEN p_partkey = 7 THEN 0 WHEN p_size >= 48 THEN 1 ELSE 2 END AS step, CASE WHEN p_partkey = 7 THEN 0 WHEN p_size >= 48 THEN p_size ELSE -p_size END AS o FROM part)
        SELECT p_partkey, p_size, position FROM (SELECT p_partkey, p_size, (row_number() OVER (ORDER BY step, o, p_partkey))::INTEGER AS position FROM a) WHERE position <= 8""",
    "venue_score": """WITH m AS (SELECT p_partkey, p_size, p_size >= 20 AS fits, p_partkey % 5 = 0 OR p_partkey % 3 <> 0 AS access, p_partkey % 2 = 0 AS park, contains(lower(p_name), lower(split_part(p_type, ' ', 1))) AS typed, p_partkey % 4 IN (0, 2) AS inside FROM part)
        SELECT p_partkey, (fits::INT * 30 + access::INT * 25 + park::INT * 15 + typed::INT * 20 + CASE WHEN inside THEN 10 ELSE 7 END)::INTEGER AS score, fits AND access AS eligible,
        concat_ws(',', fits::INT * 100, access::INT * 100, park::INT * 100, typed::INT * 100, CASE WHEN inside THEN 100 ELSE 70 END) AS percents,
        concat_ws('|', CASE WHEN NOT fits THEN 'Capacity is ' || p_size || ', below the required 20 guests.' END, CASE WHEN NOT access THEN 'The event requires accessibility, but this venue is not wheelchair accessible.' END, CASE WHEN NOT park THEN 'Venue parking is unavailable.' END) AS risks FROM m""",
    "final_score": """WITH m AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size * 2.0::DOUBLE END AS s, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 101)::DOUBLE END AS w, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 7 * 10)::DOUBLE END AS r FROM part)
        SELECT p_partkey, round_even(round((coalesce(s * 0.70::DOUBLE, 0) + coalesce(w * 0.15::DOUBLE, 0) + coalesce(r * 0.15::DOUBLE, 0)) / nullif((s IS NOT NULL)::INT * 0.70::DOUBLE + (w IS NOT NULL)::INT * 0.15::DOUBLE + (r IS NOT NULL)::INT * 0.15::DOUBLE, 0), 9), 0)::INTEGER AS final FROM m""",
    "readiness_score": """WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a, sum(l_quantity)::BIGINT AS q, count(*) FILTER (l_discount > 0.05) AS x FROM lineitem GROUP BY 1),
        p AS (SELECT l_orderkey, [('weather:' || r || ' weather risk(s) detected', least(r * 8, 24)), ('staffing:Short by ' || a || ' host(s)', least(a * 10, 30)), ('staffing:No team leader assigned', CASE WHEN n = 1 THEN 10 ELSE 0 END), ('staffing:Inactive hosts are assigned', least(x * 10, 20)),
              ('logistics:Guest count exceeds venue capacity', CASE WHEN q > n * 25 THEN 25 ELSE 0 END), ('logistics:Required transportation plan is missing', CASE WHEN q % 3 = 0 THEN 15 ELSE 0 END),
              ('logistics:Transportation seats are insufficient', CASE WHEN q % 5 = 0 THEN 15 ELSE 0 END), ('logistics:Clothing stock is insufficient', CASE WHEN q % 7 = 0 THEN 15 ELSE 0 END)] AS d FROM l),
        s AS (SELECT l_orderkey, greatest(0, 100 - list_sum(list_transform(d, lambda y: y[2]))) AS score, array_to_string(list_transform(list_filter(d, lambda y: y[2] > 0), lambda y: y[1] || ':' || y[2]), ',') AS deductions FROM p)
        SELECT l_orderkey, score::INTEGER AS score, CASE WHEN score >= 85 THEN 'ready' WHEN score >= 60 THEN 'needs_attention' ELSE 'high_risk' END AS level, deductions FROM s""",
    "weather_score": """WITH e AS (SELECT event_id, event_type = 'error' AS failed, event_id % 3 AS s, event_id % 100 >= 60 OR event_id % 7 >= 5 AS rain, event_id % 50 >= 35 AS wind, event_id % 41 >= 34 AS hot, event_id % 23 <= 5 AS cold FROM events)
        SELECT event_id, CASE WHEN NOT failed THEN greatest(0, 100 - rain::INT * CASE s WHEN 0 THEN 40 WHEN 1 THEN 20 ELSE 5 END - wind::INT * CASE WHEN s < 2 THEN 25 ELSE 5 END - hot::INT * CASE WHEN s < 2 THEN 20 ELSE 5 END)::INTEGER END AS score,
        CASE WHEN failed THEN 'unavailable' ELSE concat_ws(',', CASE WHEN rain THEN 'rain' END, CASE WHEN wind THEN 'wind' END, CASE WHEN hot THEN 'heat' END, CASE WHEN cold THEN 'cold' END) END AS risks FROM e""",
    "route_band": """SELECT CASE WHEN m IS NULL THEN 0 WHEN m <= 5 THEN 100 WHEN m <= 15 THEN 80 WHEN m <= 30 THEN 60 WHEN m <= 50 THEN 40 ELSE 20 END AS band, count(*) AS n FROM (SELECT CASE WHEN event_type <> 'error' THEN event_id % 70 END AS m FROM events) GROUP BY 1""",
    "transport_summary": "SELECT l_orderkey, needed, worst, worst > 0 AND needed <= floor(worst * 0.6::DOUBLE + 0.5) AS downgrade FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS needed, count(*) AS worst FROM lineitem GROUP BY 1)",
    "guard_scan": f"""WITH t AS (SELECT doc_id, {_STRIP('text')} AS text FROM documents)
        SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN length(text) > 1000 THEN 'too_long' WHEN {_any('lower(text)', INPUT_PATTERNS)} THEN 'injection' END AS input_reason,
        CASE WHEN text = '' THEN 'empty' WHEN {_any('text', [f'(?i){p}' for p in OUTPUT_PATTERNS])} THEN 'sensitive' END AS output_reason FROM t""",
    "set_diff_arrays": """WITH h AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS have FROM events GROUP BY 1), need AS (SELECT ['signup', 'purchase', 'click', 'refund'] AS need)
        SELECT user_id, array_to_string(list_sort(list_filter(need, lambda x: NOT list_contains(have, x))), ',') AS missing, array_to_string(list_concat(have, list_filter(need, lambda x: NOT list_contains(have, x))), ',') AS all_types FROM h, need""",
    "stock_upsert": f"SELECT coalesce(a.item, b.item) AS item, coalesce(a.size, b.size) AS size, coalesce(a.qty, 0) + coalesce(b.qty, 0) AS qty FROM ({_STOCK('R')}) a FULL JOIN ({_STOCK('A')}) b ON a.item = b.item AND a.size = b.size",
    "guarded_decrement": f"SELECT coalesce(a.item, b.item) AS item, coalesce(a.size, b.size) AS size, CASE WHEN a.qty >= b.qty THEN a.qty - b.qty ELSE a.qty END AS qty, b.qty IS NOT NULL AND NOT coalesce(a.qty >= b.qty, false) AS rejected FROM ({_STOCK('R')}) a FULL JOIN ({_STOCK('A')}) b ON a.item = b.item AND a.size = b.size",
    "index_sync": """WITH n AS (SELECT doc_id, source, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
        SELECT doc_id AS point_id, source AS source_path, length(text) AS chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source = d.source)
        UNION ALL SELECT doc_id, source, -length(text) FROM n""",
    "json_props": "SELECT event_type, count(*) AS n, count(k) AS with_k, min(k) AS least, max(k) AS most, sum(k)::BIGINT AS total FROM (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1",
    "classifier_eval": """WITH r AS (SELECT l.quality AS label, CASE WHEN length(regexp_replace(d.text, '[^A-Z!|$%&*#]', '', 'g')) / greatest(length(d.text), 1) > 0.2 THEN 0 ELSE 1 END AS predicted FROM documents d JOIN labels l USING (doc_id)),
        k AS (SELECT DISTINCT c FROM (SELECT label AS c FROM r UNION ALL SELECT predicted FROM r))
        SELECT (SELECT count(*) FROM r) AS n, (SELECT round(avg((label = predicted)::INTEGER), 6) FROM r) AS accuracy, round(avg((SELECT 2 * count(*) FILTER (label = c AND predicted = c) / (count(*) FILTER (label = c) + count(*) FILTER (predicted = c)) FROM r)), 6) AS macro_f1 FROM k""",
    "title_case": """SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(p_name || '_' || p_type, '[\\s_]+'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), ' ') AS title FROM part""",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL",
    "top_per_group": "SELECT source, doc_id, n_chars, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 5",
}
