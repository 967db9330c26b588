"""DuckDB SQL equal to each registered query (views of the driver tables are pre-registered)."""

from __future__ import annotations

CELLS = """
WITH raw AS (
  SELECT 'region' AS sheet, 0 AS sheet_idx, row_number() OVER (ORDER BY r_regionkey) AS row,
         unnest([1]) AS col, unnest([r_name]) AS value FROM region
  UNION ALL SELECT 'nation', 1, row_number() OVER (ORDER BY n_nationkey),
         unnest([1,2]), unnest([n_name, CAST(n_regionkey AS VARCHAR)]) FROM nation
  UNION ALL SELECT 'supplier', 2, row_number() OVER (ORDER BY s_suppkey),
         unnest([1,2,3]), unnest([s_name, CAST(s_nationkey AS VARCHAR),
                                  CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR)]) FROM supplier
  UNION ALL SELECT 'customer', 3, row_number() OVER (ORDER BY c_custkey),
         unnest([1,2,3]), unnest([c_name, CASE WHEN c_nationkey % 4 <> 0 THEN CAST(c_nationkey AS VARCHAR) END,
                                  c_mktsegment]) FROM customer
  UNION ALL SELECT 'part', 4, row_number() OVER (ORDER BY p_partkey),
         unnest([1,2,3,4,5]), unnest([p_name, p_brand, CASE WHEN p_partkey % 5 <> 0 THEN p_type END,
           CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS VARCHAR) END,
           CASE WHEN p_partkey % 7 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END]) FROM part
), cells AS (
  SELECT sheet, sheet_idx, row, col, value,
         CASE WHEN regexp_full_match(value, '[+-]?[0-9]+([.][0-9]+)?') THEN CAST(value AS DOUBLE) END AS num
  FROM raw WHERE value IS NOT NULL AND value <> ''
)
"""

STOP = "('the','a','an','and','or','but','in','on','at','to','for','of','with','by','is')"

_SQL: dict[str, str] = {}
_NEEDS_CELLS: set[str] = set()


# Unicode white space, on which tokens are split; written '\\s+' in the strings below.
SPACE = "'[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'"


def sql(name: str, text: str, cells: bool = False) -> None:
    _SQL[name] = text.replace("'\\s+'", SPACE)
    if cells:
        _NEEDS_CELLS.add(name)


sql("cells_scan", "SELECT sheet, row, col, chr(CAST(64 + col AS INT)) || CAST(row AS VARCHAR) AS ref, value FROM cells",
    cells=True)

sql("a1_encode", """
SELECT p_partkey + 1 AS n, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT))
  WHEN n <= 702 THEN chr(CAST(64 + (n-1)//26 AS INT)) || chr(CAST(65 + (n-1)%26 AS INT))
  ELSE chr(CAST(65 + (n-703)//676 AS INT)) || chr(CAST(65 + ((n-703)//26)%26 AS INT)) || chr(CAST(65 + (n-703)%26 AS INT)) END AS name
FROM part""")

sql("postings", f"""
SELECT tok, COUNT(*) AS tf, COUNT(DISTINCT doc_id) AS df
FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS tok FROM documents)
WHERE strlen(tok) > 2 AND tok NOT IN {STOP} GROUP BY tok""")

sql("text_search", """
SELECT sheet, row, col, value FROM cells WHERE list_has_all(string_split_regex(lower(value), '\\s+'), ['cold','widget'])
ORDER BY sheet, row, col LIMIT 20""", cells=True)

sql("batch_text_search", f"""
WITH w AS (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '\\s+'))) AS tok FROM documents),
d AS (SELECT * FROM w WHERE strlen(tok) > 2 AND tok NOT IN {STOP}),
q0 AS (SELECT item_id, unnest(list_distinct(string_split_regex(lower(text), '\\s+'))) AS tok FROM benchmark),
q AS (SELECT *, COUNT(*) OVER (PARTITION BY item_id) AS n FROM q0 WHERE strlen(tok) > 2 AND tok NOT IN {STOP})
SELECT item_id, doc_id FROM q JOIN d USING (tok) GROUP BY item_id, doc_id, n HAVING COUNT(*) = n""")


def oracles() -> dict[str, str]:
    """Name -> SQL.  Strings marked ``cells=True`` are prefixed with the CELLS ``WITH`` clause;
    one that starts with ``,`` adds more CTEs to it."""
    return {k: (CELLS.rstrip() + ("\n" if v.lstrip().startswith(",") else "\n") + v.strip()
                if k in _NEEDS_CELLS else v.strip()) for k, v in _SQL.items()}

sql("window_scan", "SELECT row, col, value FROM cells WHERE sheet = 'part' AND row - 1 BETWEEN 10 AND 59 AND col - 1 BETWEEN 1 AND 3",
    cells=True)
sql("chunk_scan", """
SELECT sheet, (row - 1) // 100 AS batch, (row - 1) // 100 * 100 AS start_row, COUNT(*) AS n_cells
FROM cells WHERE sheet_idx BETWEEN 1 AND 3 GROUP BY ALL""", cells=True)
sql("sheet_profile", """
SELECT sheet, MAX(row) AS n_rows, CAST(MAX(col) AS BIGINT) AS n_cols, COUNT(*) AS nonempty,
  round(COUNT(*) / (MAX(row) * MAX(col)), 6) AS density, COUNT(*) * 50 AS footprint FROM cells GROUP BY sheet""", cells=True)
sql("sheet_chunks", """
, r AS (SELECT sheet_idx, row, MAX(col) AS len FROM cells GROUP BY ALL)
SELECT 'chunk_' || MIN(sheet_idx) || '_' || MAX(sheet_idx) AS chunk_id, CAST(SUM(len) * 50 AS BIGINT) AS size_bytes,
  SUM(len) * 50 > 10*1024*1024 AS streaming FROM r GROUP BY sheet_idx // 2""", cells=True)
sql("sheet_zones", """
, p AS (SELECT sheet, MAX(row) AS n, MAX(col) AS c FROM cells GROUP BY sheet),
z AS (SELECT sheet, n, c, unnest(range(0, n, 1000)) AS s FROM p)
SELECT sheet, 'zone_' || s // 1000 AS zone_id, 'A' || (s + 1) || ':' || chr(CAST(64 + c AS INT)) || least(s + 1000, n) AS rng,
  least(s + 1000, n) - s > 500 AS compressed FROM z""", cells=True)
sql("nav_pages", """
, s AS (SELECT DISTINCT sheet, sheet_idx FROM cells)
SELECT sheet, sheet_idx // 2 AS page, lead(sheet) OVER (ORDER BY sheet_idx) AS next_sheet,
  lag(sheet) OVER (ORDER BY sheet_idx) AS prev_sheet FROM s""", cells=True)
sql("key_points", """
SELECT DISTINCT sheet, 'A1' AS ref, 'corner' AS role FROM cells WHERE row = 1
UNION ALL SELECT sheet, chr(CAST(64 + col AS INT)) || '1', 'header' FROM (SELECT sheet, unnest(range(1, least(MAX(col), 5) + 1)) AS col FROM cells WHERE row = 1 GROUP BY sheet)
UNION ALL SELECT sheet, 'A' || row, 'first_col' FROM (SELECT sheet, unnest(range(1, least(MAX(row), 5) + 1)) AS row FROM cells GROUP BY sheet)""",
    cells=True)
sql("hot_zones", """
, len AS (SELECT sheet, row, MAX(col) AS l FROM cells GROUP BY ALL), n AS (SELECT sheet, MAX(row) AS n FROM cells GROUP BY sheet),
t AS (SELECT sheet, (row-1)//10 AS tr, (col-1)//10 AS tc, COUNT(*) AS k FROM cells WHERE col <= 50 GROUP BY ALL),
d AS (SELECT sheet, (row-1)//10 AS tr, tc, SUM(greatest(least(l - tc*10, 10), 0)) AS tot FROM len, (SELECT unnest(range(5)) AS tc) GROUP BY ALL)
SELECT t.sheet, t.tr * 10 + 1 AS first_row, t.tc * 10 + 1 AS first_col, round(k / tot, 6) AS density FROM t JOIN d USING (sheet, tr, tc) JOIN n USING (sheet)
WHERE t.tr * 10 < n - 10 AND k / tot > 0.7""", cells=True)
sql("value_types", """
SELECT sheet, COUNT(num) AS n_number, COUNT(*) - COUNT(num) AS n_text, CAST(MAX(row) * MAX(col) - COUNT(*) AS BIGINT) AS n_empty
FROM cells GROUP BY sheet""", cells=True)
sql("column_stats", """
SELECT sheet, col, COUNT(num) AS n, MIN(num) AS lo, MAX(num) AS hi, round(AVG(num), 4) AS mean, round(stddev_samp(num), 4) AS sd
FROM cells WHERE num IS NOT NULL GROUP BY ALL""", cells=True)
sql("outliers", """
WITH s AS (SELECT l_returnflag AS g, AVG(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem JOIN s ON g = l_returnflag
WHERE abs(l_extendedprice - m) > 1.7 * sd""")
sql("exact_gate", "SELECT sheet, row, col FROM cells WHERE value IN (SELECT 'NATION_' || r_regionkey FROM region)", cells=True)
sql("numeric_range", "SELECT sheet, row, col, num FROM cells WHERE num >= 10 AND num < 20", cells=True)
sql("numeric_last_wins", """
SELECT sheet, num, CAST(MAX(row * 100 + col) // 100 AS BIGINT) AS row, CAST(MAX(row * 100 + col) % 100 AS BIGINT) AS col
FROM cells WHERE num IS NOT NULL GROUP BY ALL""", cells=True)
sql("range_batch", """
SELECT p_partkey, COUNT(*) AS n FROM part JOIN lineitem
  ON l_extendedprice >= p_retailprice * p_size AND l_extendedprice < p_retailprice * (p_size + 1)
GROUP BY p_partkey""")
sql("rect_search", "SELECT sheet, row, col, value FROM cells WHERE col - 1 >= 1 AND col - 1 < 3 AND row - 1 >= 5 AND row - 1 < 15",
    cells=True)
sql("rect_batch", """
SELECT r_regionkey AS q, sheet, COUNT(*) AS n FROM region JOIN cells
  ON row > r_regionkey * 7 AND row <= r_regionkey * 7 + 30 AND col <= r_regionkey + 1 GROUP BY ALL""", cells=True)
sql("sheet_match", """
SELECT sheet, sheet_idx, MAX(row) > 50 AS truncated, COUNT(*) FILTER (row <= 50) AS n FROM cells
WHERE contains(upper(sheet), upper('Io')) AND sheet_idx < 10 GROUP BY ALL""", cells=True)
sql("wildcard", "SELECT sheet, row, col, value FROM cells WHERE value ILIKE 'c%d w_dget'", cells=True)
sql("hit_context", """
SELECT h.sheet, h.row, h.col, f.value AS heading, n.value AS nearby FROM cells h
LEFT JOIN cells f ON f.sheet = h.sheet AND f.col = h.col AND f.row = 1
JOIN cells n ON n.sheet = h.sheet AND n.row = h.row AND abs(n.col - h.col) = 1
WHERE h.sheet = 'part' AND h.value = 'Brand#17'""", cells=True)
sql("hybrid_union", """
SELECT sheet, row, col FROM cells WHERE num >= 10 AND num < 20 UNION SELECT sheet, row, col FROM cells WHERE sheet = 'nation'""",
    cells=True)
sql("money_parse", """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS num
FROM orders""")
sql("name_patterns", """
SELECT p_size, bool_or(contains(nm, '_')) AS underscore, bool_or(contains(nm, ' ')) AS space,
  bool_or(regexp_matches(nm, '^[0-9]')) AS digit,
  bool_or(contains(nm, '2023') OR contains(nm, '2024') OR contains(nm, '2025')) AS has_year
FROM (SELECT p_size, CASE WHEN p_size = 1 THEN p_size || '_' || p_brand WHEN p_size = 2 THEN 'y2024'
                          WHEN p_size = 3 THEN p_brand ELSE p_name END AS nm FROM part) GROUP BY p_size""")
sql("name_groups", """
SELECT p_partkey // 10 AS g, COUNT(DISTINCT CASE WHEN instr(p_name, '_') > 1 THEN substr(p_name, 1, instr(p_name, '_') - 1)
  WHEN instr(p_name, ' ') > 1 THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE p_name END) AS n_groups FROM part GROUP BY g""")
sql("formula_class", """
SELECT l_orderkey, CASE WHEN COUNT(*) FILTER (l_returnflag <> 'N') = 0 THEN 'none'
  WHEN COUNT(*) FILTER (l_returnflag = 'A') = 0 THEN 'simple'
  WHEN COUNT(*) FILTER (l_returnflag = 'A') / COUNT(*) FILTER (l_returnflag <> 'N') > 0.3 THEN 'complex'
  ELSE 'mixed' END AS cls FROM lineitem GROUP BY l_orderkey""")

sql("checksum_change", "SELECT doc_id, sha256(text) AS checksum, doc_id % 10 IN (0, 1) AS changed FROM documents")
sql("validated_lookup", """
SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE n_chars >= 100 AND (lang = 'en' OR quality = 1)""")
sql("sheet_compare", """
SELECT coalesce(a.user_id, b.user_id) AS user_id, round(a.v, 2) AS v_a, round(b.v, 2) AS v_b, round(a.v - b.v, 2) AS diff
FROM (SELECT user_id, SUM(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1) a
FULL JOIN (SELECT user_id, SUM(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) b ON a.user_id = b.user_id""")
sql("snapshot_diff", """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'removed' WHEN o_orderkey % 13 = 0 THEN 'cell_update' ELSE 'added' END AS change
FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0""")
sql("delta_apply", "SELECT user_id, event_type AS cell, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
sql("bulk_impact", """
SELECT user_id, COUNT(*) AS affected, CASE WHEN COUNT(*) > 70 THEN 'rebuild' ELSE 'incremental' END AS action
FROM events GROUP BY user_id""")
sql("formula_links", """
SELECT l_orderkey, l_linenumber, l_partkey, 'part' AS target_sheet, l_partkey + 1 AS target_row, 2 AS target_col
FROM lineitem WHERE l_quantity < 10
UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, 'lineitem', l_linenumber, 1 FROM lineitem WHERE NOT (l_quantity < 10)""")
sql("cyclic_core", """
WITH RECURSIVE e AS (SELECT p_partkey AS a, (p_partkey * 2 + 1) % (SELECT COUNT(*) FROM part) AS b FROM part),
r AS (SELECT a, b, 1 AS n FROM e UNION ALL SELECT r.a, e.b, n + 1 FROM r JOIN e ON e.a = r.b WHERE n <= (SELECT COUNT(*) FROM part) AND r.b <> r.a)
SELECT DISTINCT a AS node FROM r WHERE a = b""")
sql("sheet_similarity", """
WITH h AS (SELECT DISTINCT p_brand, p_type || '/' || p_size % 8 AS t FROM part), c AS (SELECT p_brand, COUNT(*) AS n FROM h GROUP BY ALL),
i AS (SELECT x.p_brand AS a, y.p_brand AS b, COUNT(*) AS k FROM h x JOIN h y ON x.t = y.t AND x.p_brand < y.p_brand GROUP BY ALL)
SELECT a, b, round(k / (ca.n + cb.n - k), 6) AS jaccard FROM i JOIN c ca ON ca.p_brand = a JOIN c cb ON cb.p_brand = b
WHERE k / (ca.n + cb.n - k) >= 0.4""")
sql("token_totals", "SELECT source, CAST(SUM(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, COUNT(*) AS n FROM documents GROUP BY source")
sql("budget_columns", """
WITH t AS (SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tok FROM documents), r AS (SELECT *, tok / 1000.0 AS x FROM t)
SELECT doc_id, tok, 1000 - tok AS remaining, tok > 1000 AS over,
  CASE WHEN x < 0.5 THEN 'none' WHEN x < 0.8 THEN 'gzip' WHEN x < 1.0 THEN 'brotli-4' ELSE 'brotli-11-truncated' END AS ladder_a,
  CASE WHEN x < 0.5 THEN 'none' WHEN x < 0.7 THEN 'gzip' WHEN x < 0.9 THEN 'brotli' ELSE 'brotli-aggressive' END AS ladder_b,
  CAST(trunc(tok * CAST(0.7 AS DOUBLE)) AS BIGINT) AS est_gzip, greatest(1, (tok + 999) // 1000) AS n_chunks,
  CAST(CASE doc_id % 4 WHEN 1 THEN 950000 ELSE 180000 END AS BIGINT) AS safe_buffer,
  CAST(CASE doc_id % 4 WHEN 1 THEN 760000 ELSE 144000 END AS BIGINT) AS optimal FROM r""")
sql("truncate_text", """
WITH t AS (SELECT doc_id, text, substr(text, 1, 400) AS cut FROM documents), p AS (SELECT *, length(cut) - instr(reverse(cut), ' ') AS sp FROM t)
SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN contains(cut, ' ') AND sp > 200 THEN substr(cut, 1, sp) || '... [truncated]'
  ELSE cut || '... [truncated]' END AS out FROM p""")
sql("running_budget", """
WITH t AS (SELECT conv_id, turn, SUM(ceil(length(text) / 4.0)) OVER (PARTITION BY conv_id ORDER BY turn) AS cum,
  COUNT(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, COUNT(*) FILTER (cum <= 200) AS kept, MAX(n) - COUNT(*) FILTER (cum <= 200) AS dropped FROM t GROUP BY conv_id""")
sql("cursor_roundtrip", """
SELECT doc_id, 'chunk_' || doc_id AS chunk_id, n_chars AS offset_, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS version,
  CASE WHEN doc_id % 10 = 0 THEN 'version' WHEN doc_id % 7 = 0 THEN 'expired' END AS error FROM documents""")
sql("page_two", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 100")
sql("query_tags", "SELECT item_id, length(text) > 200 AS high_volume, item_id % 4 IN (0, 1) AS aggregation FROM benchmark")
sql("response_profile", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 500 ELSE 100 END AS max_results,
  CASE doc_id % 3 WHEN 0 THEN 5000 WHEN 1 THEN 1000 ELSE 800 END AS window_rows,
  CASE WHEN doc_id % 2 = 0 THEN 600 ELSE 300 END AS ttl, 'nav_' || sha256(text) AS cache_key FROM documents""")
sql("sanitise", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '''=' || lang ELSE lang END AS out FROM documents")

sql("hot_keys", """
WITH RECURSIVE o AS (SELECT event_type AS k, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT k, ts, rn, 1 AS c, INTERVAL 10 MINUTE AS ttl, 0 AS hit, 0 AS promo FROM o WHERE rn = 1
  UNION ALL SELECT o.k, o.ts, o.rn, CASE WHEN o.ts - r.ts > r.ttl THEN 1 ELSE r.c + 1 END,
    CASE WHEN o.ts - r.ts > r.ttl THEN INTERVAL 10 MINUTE WHEN r.c + 1 > 3 THEN INTERVAL 20 MINUTE ELSE r.ttl END,
    CASE WHEN o.ts - r.ts > r.ttl THEN 0 ELSE 1 END,
    CASE WHEN o.ts - r.ts <= r.ttl AND r.c + 1 > 3 AND r.ttl = INTERVAL 10 MINUTE THEN 1 ELSE 0 END
  FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1)
SELECT k, COUNT(*) AS accesses, CAST(SUM(hit) AS BIGINT) AS hits, CAST(SUM(promo) AS BIGINT) AS promotions,
  round(SUM(hit) / COUNT(*), 6) AS hit_ratio FROM r GROUP BY k""")
sql("tick_metrics", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS tick, COUNT(*) AS n FROM events GROUP BY tick")
sql("key_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 HOUR THEN 0 ELSE 1 END AS nw FROM events),
s AS (SELECT *, SUM(nw) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, MIN(ts) AS first_ts, COUNT(*) AS n FROM s GROUP BY user_id, sid""")

sql("index_stats", f"""
, t AS (SELECT unnest(string_split_regex(lower(value), '\\s+')) AS tok FROM cells)
SELECT (SELECT COUNT(num) FROM cells) AS numeric_items,
  (SELECT COUNT(DISTINCT tok) FROM t WHERE strlen(tok) > 2 AND tok NOT IN {STOP}) AS distinct_tokens,
  (SELECT COUNT(*) FROM cells) AS spatial_points""", cells=True)
sql("spatial_tiles", "SELECT sheet, (row - 1) // 10 AS tile_row, CAST((col - 1) // 10 AS BIGINT) AS tile_col, COUNT(*) AS n FROM cells GROUP BY ALL",
    cells=True)
sql("postings_update", f"""
, c2 AS (SELECT sheet, row, col, CASE WHEN sheet = 'nation' AND col = 1 THEN lower(value) || ' updated' ELSE value END AS value FROM cells),
t AS (SELECT sheet, row, col, unnest(string_split_regex(lower(value), '\\s+')) AS token FROM c2),
p AS (SELECT token, sheet, row, col, COUNT(*) AS tf FROM t WHERE strlen(token) > 2 AND token NOT IN {STOP} GROUP BY ALL)
SELECT token, SUM(tf)::BIGINT AS tf, COUNT(*) AS df FROM p GROUP BY token""", cells=True)
sql("nav_page", """
, s AS (SELECT DISTINCT sheet, sheet_idx FROM cells)
SELECT sheet, sheet_idx, CAST(ceil((SELECT COUNT(*) FROM s) / 2) AS BIGINT) AS total_pages FROM s WHERE sheet_idx BETWEEN 1 AND 2""",
    cells=True)
sql("chunk_cursors", """
, c AS (SELECT sheet_idx // 2 AS ch, 'chunk_' || MIN(sheet_idx) || '_' || MAX(sheet_idx) AS chunk_id, MIN(sheet_idx) AS f
        FROM (SELECT DISTINCT sheet_idx FROM cells) GROUP BY ALL)
SELECT chunk_id, lead(chunk_id) OVER (ORDER BY f) AS next_chunk, lag(chunk_id) OVER (ORDER BY f) AS prev_chunk,
  COUNT(*) OVER (ORDER BY f ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS remaining,
  COUNT(*) OVER (ORDER BY f ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) * 2 AS eta_seconds FROM c""", cells=True)

_FIRST_ROW = """(SELECT to_json(list(coalesce(x.value, '') ORDER BY g.c))::VARCHAR FROM (SELECT unnest(range(1, (SELECT MAX(col) FROM cells z
  WHERE z.sheet = {s} AND z.row = {r}) + 1)) AS c) g LEFT JOIN cells x ON x.sheet = {s} AND x.row = {r} AND x.col = g.c)"""
sql("row_events", """
, e AS (SELECT sheet, MAX(row) AS n FROM cells GROUP BY sheet), b AS (SELECT sheet, n, unnest(range(0, n, 100)) AS s FROM e)
SELECT 'metadata' AS type, NULL AS sheet, NULL::BIGINT AS start_row, NULL::BIGINT AS n_rows, NULL AS first_row
UNION ALL SELECT 'complete', NULL, NULL, NULL, NULL
UNION ALL SELECT 'sheet_start', sheet, NULL, NULL, NULL FROM e
UNION ALL SELECT 'sheet_complete', sheet, NULL, NULL, NULL FROM e
UNION ALL SELECT 'rows', sheet, s, least(100, n - s), CASE WHEN EXISTS (SELECT 1 FROM cells x WHERE x.sheet = b.sheet AND x.row = s + 1)
  THEN """ + _FIRST_ROW.format(s="b.sheet", r="b.s + 1") + """ ELSE '[]' END FROM b""", cells=True)
sql("window_events", """
, w AS (SELECT * FROM cells WHERE sheet = 'customer' AND row <= 150 AND col <= 2),
b AS (SELECT unnest(range(0, 150, 50)) AS s)
SELECT 'window_start' AS type, 'customer' AS sheet, NULL::BIGINT AS start_row, NULL::BIGINT AS n_rows, NULL AS first_row
UNION ALL SELECT 'window_complete', NULL, NULL, NULL, NULL
UNION ALL SELECT 'window_data', NULL, s, 50, (SELECT to_json(list(coalesce(x.value, '') ORDER BY g.c))::VARCHAR FROM
  (SELECT unnest(range(1, least(2, (SELECT MAX(col) FROM cells z WHERE z.sheet = 'customer' AND z.row = b.s + 1)) + 1)) AS c) g
  LEFT JOIN w x ON x.row = b.s + 1 AND x.col = g.c) FROM b""", cells=True)
sql("export_plan", """
WITH t AS (SELECT doc_id, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tok FROM documents),
c AS (SELECT *, substr(text, 1, 2800) AS cut FROM t), p AS (SELECT *, length(cut) - instr(reverse(cut), ' ') AS sp FROM c)
SELECT doc_id, tok AS tokens,
  CASE WHEN tok / 1000.0 < 0.5 THEN 'none' WHEN tok / 1000.0 < 0.8 THEN 'gzip' WHEN tok / 1000.0 < 1.0 THEN 'brotli-4'
       ELSE 'brotli-11-truncated' END AS method,
  CASE WHEN tok < 1000 THEN length(text) WHEN length(text) <= 2800 THEN length(text)
       WHEN contains(cut, ' ') AND sp > 1400 THEN sp + 15 ELSE 2800 + 15 END AS payload_chars FROM p""")
sql("truncate_items", """
WITH t AS (SELECT conv_id, turn, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tok,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, COUNT(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
c AS (SELECT *, SUM(tok) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cum FROM t),
f AS (SELECT *, MIN(CASE WHEN cum > 200 THEN pos END) OVER (PARTITION BY conv_id) AS fo FROM c),
o AS (SELECT *, 200 - (cum - tok) AS lft, substr(text, 1, CAST((200 - (cum - tok)) * 4 AS INT)) AS cut FROM f WHERE pos = fo)
SELECT conv_id, pos, false AS is_summary, length(text) AS chars, NULL::BIGINT AS _truncated_items, NULL::BIGINT AS _total_items
  FROM f WHERE fo IS NULL OR pos < fo
UNION ALL SELECT conv_id, pos, false, CASE WHEN contains(cut, ' ') AND length(cut) - instr(reverse(cut), ' ') > floor(lft * 4 / 2)
  THEN length(cut) - instr(reverse(cut), ' ') ELSE length(cut) END + 15, NULL, NULL FROM o
UNION ALL SELECT conv_id, pos + 1, true, NULL, n - pos - 1, n FROM o WHERE pos < n - 1""")
sql("tick_hit_ratio", """
WITH RECURSIVE o AS (SELECT event_type AS k, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT k, ts, rn, 1 AS c, INTERVAL 10 MINUTE AS ttl, 0 AS hit FROM o WHERE rn = 1
  UNION ALL SELECT o.k, o.ts, o.rn, CASE WHEN o.ts - r.ts > r.ttl THEN 1 ELSE r.c + 1 END,
    CASE WHEN o.ts - r.ts > r.ttl THEN INTERVAL 10 MINUTE WHEN r.c + 1 > 3 THEN INTERVAL 20 MINUTE ELSE r.ttl END,
    CASE WHEN o.ts - r.ts > r.ttl THEN 0 ELSE 1 END
  FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1)
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS tick, COUNT(*) AS accesses, CAST(SUM(hit) AS BIGINT) AS hits,
  round(SUM(hit) / COUNT(*), 6) AS hit_ratio FROM r GROUP BY tick""")
sql("text_and_range", """
SELECT sheet, row, col FROM cells WHERE list_contains(string_split_regex(lower(value), '\\s+'), 'economy') AND col = 3""",
    cells=True)
sql("wide_extract", """
SELECT row, MAX(CASE WHEN col = 1 THEN value END) AS c1, MAX(CASE WHEN col = 2 THEN value END) AS c2,
  MAX(CASE WHEN col = 3 THEN value END) AS c3, MAX(CASE WHEN col = 4 THEN value END) AS c4,
  MAX(CASE WHEN col = 5 THEN value END) AS c5, NULL::VARCHAR AS c6, NULL::VARCHAR AS c21
FROM cells WHERE sheet = 'part' AND row <= 1000 GROUP BY row""", cells=True)
sql("truncate_fields", """
WITH RECURSIVE f AS (
  SELECT doc_id, 'metadata' AS field, lang || ' ' || source AS v, 1 AS p FROM documents
  UNION ALL SELECT doc_id, 'index', CAST(doc_id AS VARCHAR), 3 FROM documents
  UNION ALL SELECT doc_id, 'n_chars', CAST(n_chars AS VARCHAR), NULL FROM documents
  UNION ALL SELECT doc_id, 'summary', CASE WHEN doc_id % 3 = 0 THEN text ELSE lang END, 2 FROM documents
  UNION ALL SELECT doc_id, 'text', text, NULL FROM documents),
t AS (SELECT *, CAST(ceil(length(v) / 4.0) AS BIGINT) AS tok FROM f),
pr AS (SELECT doc_id, MAX(CASE WHEN p = 1 THEN tok END) AS a, MAX(CASE WHEN p = 2 THEN tok END) AS b, MAX(CASE WHEN p = 3 THEN tok END) AS c
       FROM t GROUP BY doc_id),
u1 AS (SELECT *, a <= 300 AS ka, CASE WHEN a <= 300 THEN a ELSE 0 END AS ua FROM pr),
u2 AS (SELECT *, ua + b <= 300 AS kb, CASE WHEN ua + b <= 300 THEN ua + b ELSE ua END AS ub FROM u1),
u3 AS (SELECT *, ub + c <= 300 AS kc, CASE WHEN ub + c <= 300 THEN ub + c ELSE ub END AS uc FROM u2),
k AS (SELECT t.*, coalesce(CASE p WHEN 1 THEN ka WHEN 2 THEN kb WHEN 3 THEN kc END, false) AS kept, uc FROM t JOIN u3 USING (doc_id)),
o AS (SELECT *, uc + SUM(tok) OVER (PARTITION BY doc_id ORDER BY field ROWS UNBOUNDED PRECEDING) AS cum FROM k WHERE NOT kept),
x AS (SELECT *, MIN(CASE WHEN cum > 300 THEN field END) OVER (PARTITION BY doc_id) AS fo FROM o),
cut AS (SELECT *, substr(v, 1, CAST((300 - (cum - tok)) * 4 AS INT)) AS h, 300 - (cum - tok) AS lft FROM x WHERE field = fo),
rows AS (
  SELECT doc_id, field, length(v) AS chars FROM k WHERE kept
  UNION ALL SELECT doc_id, field, length(v) FROM x WHERE fo IS NULL OR field < fo
  UNION ALL SELECT doc_id, field, CASE WHEN contains(h, ' ') AND length(h) - instr(reverse(h), ' ') > floor(lft * 4 / 2)
    THEN length(h) - instr(reverse(h), ' ') ELSE length(h) END + 15 FROM cut)
SELECT doc_id, field, CAST(chars AS BIGINT) AS chars, NULL::BIGINT AS _original_size, NULL::BIGINT AS _included_fields FROM rows
UNION ALL SELECT doc_id, '_truncated', 4, 5, COUNT(*) FROM rows GROUP BY doc_id""")

# ---------------------------------------------------------------- rows with null keys, changes of numbers and formulas, predicates
sql("null_key_budget", """
WITH c AS (SELECT CASE WHEN conv_id % 5 <> 0 THEN conv_id % 7 END AS g, conv_id * 1000 + turn AS pos, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tok FROM conversations),
r AS (SELECT *, SUM(tok) OVER (PARTITION BY g ORDER BY pos) AS cum FROM c)
SELECT g, COUNT(*) FILTER (cum <= 2000) AS kept, COUNT(*) FILTER (cum > 2000) AS dropped, MAX(cum)::BIGINT AS total FROM r GROUP BY g""")
sql("null_key_sessions", """
WITH e AS (SELECT CASE WHEN user_id % 4 <> 0 THEN user_id END AS u, ts FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY u ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS nw FROM e),
s AS (SELECT *, SUM(nw) OVER (PARTITION BY u ORDER BY ts) AS sid FROM g)
SELECT u, MIN(ts) AS first_ts, COUNT(*) AS n FROM s GROUP BY u, sid""")
sql("null_key_rows", """
SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END NULLS FIRST, o_orderkey) AS row FROM orders""")
_CHANGED = """
WITH base AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS v, CASE WHEN o_orderkey % 2 = 0 THEN 'A1+1' END AS f FROM orders),
n AS (SELECT k, CASE WHEN k % 7 = 0 THEN CASE WHEN k % 14 = 0 THEN NULL ELSE 'x' || v END WHEN k % 3 = 0 AND k % 5 = 0 THEN '42' ELSE v END AS v,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN 'B' || (k + 1) || '*2' ELSE f END AS f FROM base)
"""
sql("cell_changes", _CHANGED + "SELECT k, v, f FROM n WHERE v IS NOT NULL OR f IS NOT NULL")
sql("numeric_update", _CHANGED + """
SELECT k, CAST(v AS DOUBLE) AS num FROM n WHERE regexp_full_match(v, '[0-9]+')""")
sql("bulk_rebuilds", """
SELECT l_suppkey, CAST(SUM(l_partkey) AS BIGINT) AS affected, CASE WHEN MAX(l_partkey) > 150 THEN 'rebuild' ELSE 'incremental' END AS action
FROM lineitem GROUP BY l_suppkey""")
sql("numeric_compare", "SELECT sheet, row, col, num, num >= 20 AS ge, num <> 7 AS ne, num BETWEEN 3 AND 9 AS between_ FROM cells WHERE num IS NOT NULL",
    cells=True)
sql("text_cells", "SELECT sheet, COUNT(*) AS n FROM cells WHERE num IS NULL GROUP BY sheet", cells=True)
sql("locations", "SELECT sheet || '!' || chr(CAST(64 + col AS INT)) || row AS location, sheet, row, CAST(col AS INT) AS col FROM cells", cells=True)
sql("rects_overlap", """
SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey
WHERE NOT (a.p_size + 5 <= b.p_size OR b.p_size + 5 <= a.p_size OR a.p_partkey % 40 + 9 <= b.p_partkey % 40 OR b.p_partkey % 40 + 9 <= a.p_partkey % 40)""")
sql("dangling_links", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber % 3 = 0 OR l_partkey % 3 = 0""")
sql("export_roundtrip", """
SELECT doc_id, CASE WHEN ceil(length(text) / 4.0) < 500 THEN 'none' ELSE 'gzip' END AS codec, sha256(text) AS checksum FROM documents
WHERE ceil(length(text) / 4.0) < 1000
UNION ALL SELECT doc_id, 'gzip', NULL FROM documents WHERE ceil(length(text) / 4.0) >= 1000""")


# ---------------------------------------------------------------- spatial index, dependencies, formats, sketches
sql("spatial_rect", """
SELECT q, sheet, row, col, value FROM cells, (VALUES ('tall', 1, 20, 1, 1099511627776), ('wide', 0, 7, 100, 2), ('square', 2, 10, 2, 30)) r(q, x, y, w, h)
WHERE col - 1 >= x AND col - 1 < x + w AND row - 1 >= y AND row - 1 < y + h""", cells=True)
# the sheets of formulas: A reads lo to hi of B, B (every tenth) reads t and at times u of A
_CALC = """
WITH RECURSIVE p AS (
  SELECT p_partkey + 1 AS r, p_partkey % 100 AS i, p_partkey - p_partkey % 100 AS base, p_size, p_brand, (p_partkey * 7 + 3) % 100 AS a0 FROM part
), a AS (SELECT r, base + (i * 7 + 3) % 100 + 1 AS lo, base + least((i * 7 + 3) % 100 + p_size, 99) + 1 AS hi FROM p
), b AS (SELECT r, base + (i * 3 + 11) % 100 + 1 AS t, CASE WHEN i = 90 AND base // 100 % 2 = 0 THEN base + 101 END AS u FROM p WHERE i % 10 = 0
), reads AS (
  SELECT p.r * 4 + 2 AS cell, a.r * 4 + 1 AS formula FROM p JOIN a ON p.r BETWEEN lo AND hi
  UNION ALL SELECT p.r * 4 + 1, b.r * 4 + 2 FROM b JOIN p ON p.r = t OR p.r = u
)
"""
sql("range_cycles", _CALC + """
, e AS (SELECT formula AS s, cell AS d FROM reads WHERE cell % 4 = 1 OR cell // 4 IN (SELECT r FROM b)),
reach AS (SELECT s, d FROM e UNION SELECT reach.s, e.d FROM reach JOIN e ON reach.d = e.s),
scc AS (SELECT x.s AS n, min(x.d) AS m FROM reach x JOIN reach y ON x.s = y.d AND x.d = y.s GROUP BY x.s)
SELECT 'calc' || (n // 4 - 1) // 500 AS sheet, n // 4 AS row, CAST(n % 4 AS INTEGER) AS col, 'calc' || (m // 4 - 1) // 500 AS cycle_sheet,
  m // 4 AS cycle_row, CAST(m % 4 AS INTEGER) AS cycle_col FROM scc""")
sql("cell_readers", """
WITH p AS (SELECT p_partkey + 1 AS r, p_partkey % 100 AS i, p_partkey - p_partkey % 100 AS base, p_size FROM part),
a AS (SELECT r, base + (i * 7 + 3) % 100 + 1 AS lo, base + least((i * 7 + 3) % 100 + p_size, 99) + 1 AS hi FROM p),
b AS (SELECT r, base + (i * 3 + 11) % 100 + 1 AS t, CASE WHEN i = 90 AND base // 100 % 2 = 0 THEN base + 101 END AS u FROM p WHERE i % 10 = 0)
SELECT 'calc' || (p.r - 1) // 500 AS sheet, p.r AS row, 2 AS col, COUNT(*) AS n FROM p JOIN a ON p.r BETWEEN lo AND hi GROUP BY ALL
UNION ALL SELECT 'calc' || (p.r - 1) // 500, p.r, 1, COUNT(*) FROM p JOIN b ON p.r = t OR p.r = u GROUP BY ALL""")
_FORMULAS = """
, fa AS (SELECT r, lo, hi, 'SUM(B' || lo || ':$B$' || hi || ')' AS f FROM a),
fb AS (SELECT r, t, u, 'A' || t || '*2' || CASE WHEN u IS NULL THEN '' ELSE '+calc' || (u - 1) // 500 || '!A' || u END AS f FROM b),
hit AS (SELECT 'calc' || (r - 1) // 500 AS sheet, r AS row, 2 AS col FROM p WHERE p_size = 7)
"""
sql("hit_parts", _CALC + _FORMULAS + """
SELECT h.*, 'heading' AS part, sheet AS part_sheet, 1::BIGINT AS part_row, 2 AS part_col, CAST(p_size AS VARCHAR) AS text FROM hit h JOIN p ON p.r = 1 WHERE sheet = 'calc0'
UNION ALL SELECT h.*, 'nearby', sheet, row, 1, CAST(row - 1 AS VARCHAR) FROM hit h
UNION ALL SELECT h.*, 'nearby', sheet, row, 3, p_brand FROM hit h JOIN p ON r = row
UNION ALL SELECT h.*, 'own', sheet, row, 2, f FROM hit h JOIN fb ON r = row
UNION ALL SELECT h.*, 'reads', 'calc' || (r - 1) // 500, r, 1, f FROM hit h JOIN fa ON row BETWEEN lo AND hi""")
_REACH = _CALC + """
, reach AS (SELECT r * 4 + 2 AS n, 0 AS depth FROM p WHERE p_size = 7
  UNION SELECT formula, depth + 1 FROM reach JOIN reads ON cell = n WHERE depth < {depth}),
least AS (SELECT n, min(depth) AS depth FROM reach GROUP BY n)
"""
sql("downstream_impact", _REACH.format(depth=230) + """
SELECT 'calc' || (n // 4 - 1) // 500 AS sheet, n // 4 AS row, CAST(n % 4 AS INTEGER) AS col, depth FROM least""")
sql("rebuild_plan", _REACH.format(depth=2) + """
SELECT 'calc' || (n // 4 - 1) // 500 AS sheet, COUNT(*) AS affected, MAX(depth) AS max_depth,
  CASE WHEN COUNT(*) > 250 THEN 'rebuild' ELSE 'incremental' END AS action FROM least GROUP BY ALL""")
sql("column_masks", r"""
, l0 AS (SELECT sheet, col, regexp_replace(regexp_replace(regexp_replace(value, '\p{Lu}', 'A', 'g'), '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]', 'a', 'g'), '\p{Nd}', '9', 'g') AS m FROM cells),
g AS (SELECT sheet, col, m, COUNT(*) AS n FROM l0 GROUP BY ALL),
v AS (SELECT sheet, col, 0 AS level, m AS mask, n FROM g
  UNION ALL SELECT sheet, col, 1, regexp_replace(regexp_replace(regexp_replace(m, 'A+', 'A+', 'g'), 'a+', 'a+', 'g'), '9+', '9+', 'g'), n FROM g
  UNION ALL SELECT sheet, col, 2, regexp_replace(regexp_replace(m, '[Aa]+', 'L+', 'g'), '9+', '9+', 'g'), n FROM g
  UNION ALL SELECT sheet, col, 3, regexp_replace(m, '[Aa9]+', 'X+', 'g'), n FROM g
  UNION ALL SELECT sheet, col, 4, '*', n FROM g),
c AS (SELECT sheet, col, level, mask, SUM(n)::BIGINT AS n FROM v GROUP BY ALL),
t AS (SELECT sheet, col, level, SUM(n) AS total FROM c GROUP BY ALL HAVING COUNT(*) <= 4),
best AS (SELECT sheet, col, MIN(level) AS level FROM t GROUP BY ALL)
SELECT sheet, col, level, mask, n, round(n / total, 6) AS share FROM c JOIN best USING (sheet, col, level) JOIN t USING (sheet, col, level)""", cells=True)
sql("merged_stats", """
SELECT sheet, col, COUNT(num) AS n, MIN(num) AS lo, MAX(num) AS hi, round(AVG(num), 4) AS mean, round(stddev_samp(num), 4) AS sd
FROM cells WHERE num IS NOT NULL GROUP BY ALL""", cells=True)
sql("exact_range_counts", """
SELECT p_partkey, COUNT(*) AS n FROM part JOIN orders ON o_custkey >= p_partkey AND o_custkey < p_partkey + 2 GROUP BY p_partkey""")

# ---------------------------------------------------------------- sources, stores and streams end to end
sql("workbook_source", _CALC + _FORMULAS + """
, c AS (SELECT p.r, 1 AS col, CAST(p.r - 1 AS VARCHAR) AS value, CAST(p.r - 1 AS DOUBLE) AS num, f AS formula FROM p JOIN fa USING (r)
  UNION ALL SELECT p.r, 2, CAST(p_size AS VARCHAR), CAST(p_size AS DOUBLE), f FROM p LEFT JOIN fb USING (r)
  UNION ALL SELECT r, 3, p_brand, NULL, NULL FROM p)
SELECT 'calc' || (r - 1) // 500 AS sheet, r AS row, col, value, num, formula FROM c WHERE r > 100 AND (r - 1) // 500 IN (0, 1, 3)""")
sql("workbook_facts", """
WITH p AS (SELECT p_partkey + 1 AS r, p_partkey % 100 AS i, (p_partkey - p_partkey % 100) // 500 AS s FROM part),
sh AS (SELECT s, MAX(r) AS n, COUNT(*) FILTER (r <= 10) + COUNT(*) FILTER (r <= 10 AND i % 10 = 0) AS f FROM p GROUP BY s)
SELECT 'Book ' || s // 2 AS workbook, 64 AS digits, COUNT(*) AS sheets_count,
  round(least(10.0, CAST(COUNT(*) * 0.1 + SUM(0.001 * n + 0.1 * f) AS DOUBLE)), 6) AS complexity, 1048576 + 512000 * COUNT(*) AS memory_estimate
FROM sh GROUP BY s // 2""")
sql("delta_store", _SQL["cell_changes"])
sql("hot_key_totals", f"SELECT k, accesses, hits, promotions FROM ({_SQL['hot_keys'].strip()})")
sql("event_readback", """
, e AS (SELECT sheet, MAX(row) AS n FROM cells GROUP BY sheet)
SELECT unnest(['metadata', 'complete', 'sheet_start', 'sheet_complete', 'rows']) AS type,
  unnest([1, 1, COUNT(*), COUNT(*), CAST(SUM((n + 99) // 100) AS BIGINT)]) AS n FROM e""", cells=True)
sql("stored_index", """
SELECT 'text' AS q, sheet, row, col FROM cells WHERE list_has_all(string_split_regex(lower(value), '\\s+'), ['cold','widget'])
UNION ALL SELECT 'range', sheet, row, col FROM cells WHERE num >= 10 AND num < 20
UNION ALL SELECT 'rect', sheet, row, col FROM cells WHERE col BETWEEN 2 AND 3 AND row BETWEEN 6 AND 15""", cells=True)
sql("has_more", """
SELECT o_orderkey, (SELECT COUNT(*) FROM orders) > 50 AS probe, (SELECT COUNT(*) FROM orders) >= 50 AS at_least FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
sql("formula_sample", """
WITH p AS (SELECT p_partkey + 1 AS r, p_partkey % 100 AS i, (p_partkey - p_partkey % 100) // 500 AS s FROM part),
c AS (SELECT 'b' || s % 2 AS workbook, s, r FROM p UNION ALL SELECT 'b' || s % 2, s, r FROM p WHERE i % 10 = 0)
SELECT workbook, COUNT(*) FILTER (s < 2 AND r <= 600) AS sampled, 'simple' AS sampled_class, COUNT(*) AS n_formulas, 'simple' AS cls FROM c
GROUP BY workbook HAVING COUNT(*) FILTER (s < 2 AND r <= 600) > 0""")
sql("cursor_checks", "SELECT doc_id, doc_id % 3 <> 0 AS ok FROM documents")
sql("json_token_counts", "SELECT doc_id, CAST(ceil((6 + length(CAST(n_chars AS VARCHAR))) / 4.0) AS BIGINT) AS tokens FROM documents")
