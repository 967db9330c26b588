"""DuckDB SQL of the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS begins,
    length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|TURN\])', '\1\2\\\3', 'g')) AS n_text,
    length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|TURN\])', '\1\2\\\3', 'g')) AS n_role
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n_text + CASE WHEN begins THEN 20 + n_role ELSE 6 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

DECONTAMINATION = rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x80-\x{{10FFFF}}]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, k + 1, k + least(13, len(w))), ' ') AS gram, least(13, len(w)) AS n
  FROM item_words, range(greatest(1, len(w) - 12)) AS r(k) WHERE len(w) > 0 AND item_id IS NOT NULL
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x80-\x{{10FFFF}}]+') AS w
  FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(len(w))) AS k FROM doc_words
), sizes AS (SELECT DISTINCT n FROM windows
), grams AS (
  SELECT doc_id, k, n, array_to_string(list_slice(w, k + 1, k + n), ' ') AS gram FROM places, sizes WHERE k + n <= len(w)
), found AS (
  SELECT doc_id, k, n, item_id FROM grams JOIN windows USING (n, gram)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_WORDS = ("adult bet bets betting bingo cams casino casinos cialis escort escorts hentai jackpot lottery nude payday pills poker "
          "porn roulette sex slots viagra warez xxx").split()

URL_FILTER = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM rest
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT k, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY k ORDER BY length(rule_host) + length(rule_path) DESC) AS place
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, CASE WHEN verdict IS NOT NULL THEN verdict
  WHEN regexp_matches(host, '(^|[^0-9a-z])({"|".join(_WORDS)})([^0-9a-z]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (k)
"""

LEXICAL_SEARCH = rf"""
WITH doc_words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\x80-\x{{10FFFF}}]+')) AS term
  FROM documents
), item_terms AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\x80-\x{{10FFFF}}]+')) AS term
    FROM benchmark) GROUP BY ALL
), lengths AS (SELECT doc_id, count(*) AS n FROM doc_words GROUP BY doc_id
), totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths
), entries AS (
  SELECT term, doc_id, count(*) AS tf FROM doc_words WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM entries GROUP BY term), totals
), scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM item_terms JOIN entries USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^ \t\n\v\f\r]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM texts
), label AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS fails
  FROM words LEFT JOIN label USING (doc_id)
), masks AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL
), letter(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM orders, range(1, 6) AS r(step)
), counts AS (
  SELECT part, filter_order, step, f,
    CAST(sum(CASE WHEN translate(fails, before || f, '') = fails THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counts
"""

ORACLES: dict[str, str] = {
    "op3_warc": WARC,
    "op6_chat_formatting": CHAT_FORMAT,
    "op8_benchmark_decontamination": DECONTAMINATION,
    "op11_url_filter": URL_FILTER,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_filter_audit": FILTER_AUDIT,
}
