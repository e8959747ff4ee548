"""DuckDB twins of the queries that SQL can express, written from the contracts, not from the operators."""

WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.n, dw.i, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit_words AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, source, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
lines AS (
  SELECT doc_id, source, text, line, {WORDS.format("line")} AS lw
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE len({WORDS.format("line")}) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
normal AS (
  SELECT doc_id, source, text, len(lw) AS n,
         regexp_replace({LOWER.format("array_to_string(lw, ' ')")}, '[0-9]', '0', 'g') AS line
  FROM lines),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
frequent AS (
  SELECT n.source, n.line, min(n.doc_id) AS keeper
  FROM normal n JOIN hosts h USING (source)
  GROUP BY n.source, n.line, h.n HAVING count(DISTINCT n.text) > 10 AND count(DISTINCT n.text) * 100 > h.n * 10),
gone AS (
  SELECT n.doc_id, sum(n.n) AS n FROM normal n JOIN frequent f ON n.source = f.source AND n.line = f.line
  WHERE n.doc_id <> f.keeper GROUP BY n.doc_id),
base AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       CAST(n_removed_words AS BIGINT) AS n_removed_words,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - n_removed_words) >= 30 * n_words AS kept
FROM base
"""

HOST = LOWER.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
OP10 = rf"""
WITH p AS (
  SELECT page_id, {LOWER.format("coalesce(url, '')")} AS low, {HOST} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id),
found AS (
  SELECT page_id,
    CASE WHEN regexp_matches(low, '://help\.[^/]+/(account/)?login(/|\?|$)') THEN 'help-login'
         WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://(ads?|adserver|banners)\.[^/]+/') THEN 'adserver'
         WHEN regexp_matches(low, '/cart/checkout(/|\?|$)') THEN 'cart-checkout'
         WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://[^/?#]*\bcasino\b') THEN 'casino'
         WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?cheap-pills\.') THEN 'cheap-pills'
         WHEN regexp_matches(low, '/(account/)?login(/|\?|$)') THEN 'login'
         WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?spam-farm\.') THEN 'spam-farm'
         WHEN regexp_matches(low, '/pixel\.(gif|png)(\?|$)') THEN 'tracking-pixel' END AS pattern_rule
  FROM p)
SELECT p.page_id, p.host, p.path, fit.rule, found.pattern_rule,
       coalesce(fit.verdict, CASE WHEN found.pattern_rule = 'help-login' THEN 'allow' WHEN found.pattern_rule IS NOT NULL THEN 'block' END,
                'allow') AS verdict
FROM p LEFT JOIN fit USING (page_id) JOIN found USING (page_id)
"""

OP1 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS kept FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN k.kept <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.kept <> d.page_id THEN k.kept END AS refers_to
FROM d LEFT JOIN k ON d.digest = k.digest AND d.n >= 1000
"""

OP11 = """
WITH scaled AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM scaled a JOIN scaled b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""

ORACLE = {"op1_warc": OP1, "op5_decontaminate": OP5, "op7_line_rules": OP7, "op10_url_rules": OP10, "op11_hard_negatives": OP11}
