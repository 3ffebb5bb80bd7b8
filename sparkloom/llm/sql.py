"""DuckDB SQL of the training-data queries that SQL can express.

The others (classifiers, token counts, packing, secret positions, approximate neighbours) are held against
brute force in tests/llm. The near-duplicate and contamination SQL is brute force, for small tables.
"""

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
    reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id, least(d.doc_id, coalesce(r.b, d.doc_id)) = d.doc_id AS kept
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least r ON r.a = d.doc_id"""

_TRIM = "trim({}, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
_LINES = f"""WITH l AS (SELECT DISTINCT source, {_TRIM.format('line')} AS line FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE source IS NOT NULL)),
    gone AS (SELECT line FROM l WHERE line <> '' GROUP BY 1 HAVING count(*) >= 5),
    g AS (SELECT list(line) AS gone FROM gone),
    d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, {_TRIM.format('x')})) AS kept FROM documents, g),
    c AS (SELECT *, len(kept) < len(lines) AND len(list_filter(kept, lambda x: {_TRIM.format('x')} <> '')) > 0 AS cut FROM d)
    SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, CASE WHEN cut THEN len(lines) - len(kept) ELSE 0 END::BIGINT AS n_removed, CASE WHEN cut THEN array_to_string(kept, chr(10)) ELSE text END AS clean_text FROM c"""

_SAID = r"'<|' || coalesce(role, '') || '|>' || chr(10) || replace(replace(coalesce({}, ''), '\', '\\'), '<|', '<\|') || chr(10)"
_PAIRS = f"""WITH said AS (SELECT conv_id, max(turn) AS fin, arg_max(coalesce(text, ''), turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1), last AS (SELECT *, lead(answer) OVER (ORDER BY conv_id) AS next FROM said),
    t AS (SELECT c.conv_id, c.turn, c.role, c.turn = l.fin AS ends, {_SAID.format('c.text')} AS mine, CASE WHEN c.turn = l.fin THEN {_SAID.format('l.next')} ELSE {_SAID.format('c.text')} END AS other, l.next IS NOT NULL AS paired
          FROM conversations c JOIN last l ON l.conv_id = c.conv_id AND c.turn <= l.fin),
    p AS (SELECT *, paired AND mine = other AS common FROM t),
    o AS (SELECT *, sum(CASE WHEN common THEN 0 ELSE length(mine) END) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM p)
    SELECT conv_id AS pair_id, count(*) FILTER (common)::BIGINT AS n_prompt, coalesce(string_agg(mine, '' ORDER BY turn) FILTER (common), '') AS prompt, coalesce(string_agg(mine, '' ORDER BY turn) FILTER (NOT common), '') AS chosen,
        coalesce(string_agg((upto - length(mine))::BIGINT || ':' || upto::BIGINT, ',' ORDER BY turn) FILTER (NOT common AND role = 'assistant'), '') AS chosen_spans,
        coalesce(string_agg(other, '' ORDER BY turn) FILTER (NOT common AND paired), '') AS rejected, coalesce(string_agg('0:' || length(other), ',') FILTER (NOT common AND paired), '') AS rejected_spans FROM o GROUP BY conv_id"""

_WORDS = rf"regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LEAKS = rf"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i : i + 9], ' '))) AS x FROM b WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM win),
    g AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM d, sizes)),
    m AS (SELECT g.doc_id, g.n, g.i, item_id FROM g JOIN win USING (n, x)),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM m)) GROUP BY 1),
    k AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)"""

_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))"""
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_SIDES = "coalesce(string_agg(h, '') OVER (PARTITION BY {0}lvl, i // 16 ORDER BY i ROWS BETWEEN {1}), '')"
_BEFORE, _AFTER = "UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"
_MANIFEST = f"""WITH RECURSIVE d AS (SELECT *, CASE WHEN xor({_CRC.format('(doc_id::VARCHAR)')}, 4294967295::BIGINT) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents),
    l AS (SELECT row_number() OVER () AS r, doc_id, source AS g, {_LEAF.format('text')} AS leaf, {_LEAF.format('changed')} AS checked FROM d),
    p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
    up AS (SELECT g, 0 AS lvl, i, leaf AS h, n FROM p UNION ALL SELECT g, lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM up WHERE n > 1 GROUP BY g, lvl, i // 16),
    sub AS (SELECT g, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
    top AS (SELECT 0 AS lvl, i, subroot AS h, n FROM sub UNION ALL SELECT lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM top WHERE n > 1 GROUP BY lvl, i // 16),
    a AS (SELECT g, lvl, i, n, {_SIDES.format('g, ', _BEFORE)} AS before, {_SIDES.format('g, ', _AFTER)} AS after FROM up),
    b AS (SELECT lvl, i, n, {_SIDES.format('', _BEFORE)} AS before, {_SIDES.format('', _AFTER)} AS after FROM top),
    steps AS (SELECT r, lvl AS k, before, after FROM p JOIN a ON a.g IS NOT DISTINCT FROM p.g AND a.i = p.i // (16 ** a.lvl)::BIGINT AND a.n > 1
        UNION ALL SELECT r, depth + lvl, before, after FROM p JOIN sub ON sub.g IS NOT DISTINCT FROM p.g JOIN b ON b.i = sub.i // (16 ** b.lvl)::BIGINT AND b.n > 1),
    fold AS (SELECT r, 0 AS k, checked AS h, '' AS proof FROM p UNION ALL SELECT fold.r, fold.k + 1, sha256(before || h || after), proof || before || after FROM fold JOIN steps ON steps.r = fold.r AND steps.k = fold.k),
    ends AS (SELECT r, arg_max(h, k) AS folded_root, sha256(arg_max(proof, k)) AS proof_sha256 FROM fold GROUP BY r)
    SELECT doc_id, leaf, subroot, top.h AS root, proof_sha256, folded_root, folded_root = top.h AS verified FROM p JOIN ends USING (r) JOIN sub ON sub.g IS NOT DISTINCT FROM p.g JOIN top ON top.n = 1"""

_TERMS = rf"regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_RANKED = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents), q AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark),
    c AS (SELECT count(*)::BIGINT AS big_n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
    tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
    wt AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, c GROUP BY term, big_n),
    qt AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS term FROM q) GROUP BY ALL),
    s AS (SELECT item, item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // l))))::BIGINT AS score
          FROM qt JOIN tf USING (term) JOIN wt USING (term), c GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""

ORACLES: dict[str, str] = {"op1_minhash": _NEAR, "op2_line_dedup": _LINES, "op3_preference": _PAIRS, "op6_decontamination": _LEAKS, "op11_search": _RANKED, "op12_merkle": _MANIFEST}
