"""Shared DuckDB CTEs: the same derived inputs as lawloom.plans.inputs, and the segmentation steps."""

from __future__ import annotations

import re

from lawloom.functions import legal as L
from lawloom.plans import inputs as I


def duck_rule(rule: str) -> str:
    return rule.format(
        i="(i - 1)", div="//", text="VARCHAR", nl="chr(10)", tab="chr(9)", cr="chr(13)", nbsp="chr(160)",
        open="{", close="}",
    )


def _per_line(rule: str) -> str:
    return (
        "SELECT doc_id, lang, source, array_to_string(list_transform(string_split(text, chr(10)), "
        f"lambda x, i: {duck_rule(rule)}), chr(10)) AS text FROM documents"
    )


def fold(x: str) -> str:
    return f"replace(strip_accents(lower({x})), 'đ', 'd')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def keyword_text(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '[^a-z0-9]+', ' ', 'g'))"


def normalize(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def parser_line(x: str) -> str:
    bare = strip(rf"regexp_replace({strip(x)}, '^\s*#{{1,6}}\s*', '')")
    return rf"CASE WHEN {bare} <> '' AND NOT regexp_full_match({bare}, '\d{{1,3}}') THEN {bare} END"


def rx(pattern: str) -> str:
    """A Java pattern of the library as an RE2 literal."""
    return "'" + pattern.replace("(?iu)", "(?i)").replace("(?U)", "").replace("'", "''") + "'"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {rx(pattern)})"


def group(x: str, pattern: str, n: int) -> str:
    return f"regexp_extract({x}, {rx(pattern)}, {n})"


def real_appendix(x: str) -> str:
    words = rf"(?:^|[^a-z0-9_])(?:{L.APPENDIX_REFERENCE_WORDS})(?:[^a-z0-9_]|$)"
    c = collapse(x)
    return (
        f"(length({c}) <= 50 AND NOT regexp_matches({c}, '[()]') AND NOT regexp_matches({fold(c)}, '{words}') "
        f"AND {matches(c, L.APPENDIX)})"
    )


def looks_real(x: str) -> str:
    return f"(length({x}) <= 180 AND NOT {matches(x, L.THOUSANDS)})"


def inner_kind(x: str) -> str:
    number = rf"regexp_replace({group(x, L.NUMBERED, 1)}, '\.+$', '')"
    return f"""CASE WHEN {matches(x, L.ROMAN)} AND {looks_real(x)} THEN 'roman'
      WHEN {matches(x, L.POINT)} THEN 'point' WHEN {matches(x, L.BULLET)} THEN 'bullet'
      WHEN {group(x, L.NUMBERED, 1)} <> '' AND {looks_real(x)}
        THEN CASE WHEN contains({number}, '.') THEN 'numbered' ELSE 'clause' END END"""


def inner_number(x: str) -> str:
    number = rf"regexp_replace({group(x, L.NUMBERED, 1)}, '\.+$', '')"
    return f"""CASE {inner_kind(x)} WHEN 'roman' THEN {group(x, L.ROMAN, 1)}
      WHEN 'point' THEN {group(x, L.POINT, 1)} WHEN 'numbered' THEN {number} WHEN 'clause' THEN {number} END"""


def inner_level(x: str) -> str:
    number = rf"regexp_replace({group(x, L.NUMBERED, 1)}, '\.+$', '')"
    return f"""CASE {inner_kind(x)} WHEN 'roman' THEN 1 WHEN 'point' THEN 3 WHEN 'bullet' THEN 4 WHEN 'clause' THEN 2
      WHEN 'numbered' THEN len(string_split({number}, '.')) + 1 END"""


def false_heading(x: str, kind: str) -> str:
    return rf"""(length({x}) > 180 OR {matches(x, L.THOUSANDS)} OR ({kind} IN ('clause', 'numbered') AND (
      regexp_matches({x}, '^\d+\.\s*$') OR (regexp_matches({x}, '^\d+\s') AND NOT regexp_matches({x}, '^\s*\d+\.') AND (
        TRY_CAST(regexp_extract({x}, '^(\d+)', 1) AS HUGEINT) > 20
        OR TRY_CAST(regexp_extract({x}, '^(\d+)', 1) AS HUGEINT) IS NULL
        OR regexp_matches({fold(x)}, '{L.ADDRESS_WORDS}'))))))"""


def accepted(x: str, *kinds: str) -> str:
    """The heading kind when it is allowed and real."""
    listed = ", ".join(f"'{k}'" for k in kinds)
    kind = inner_kind(x)
    return f"CASE WHEN ({kind}) IN ({listed}) AND NOT {false_heading(x, '(' + kind + ')')} THEN ({kind}) END"


def action(x: str) -> str:
    f = fold(x)
    return f"""CASE WHEN contains({f}, 'sua doi') THEN 'modify' WHEN contains({f}, 'bo sung') THEN 'supplement'
      WHEN contains({f}, 'thay the') THEN 'replace' WHEN contains({f}, 'bai bo') THEN 'repeal' ELSE 'unknown' END"""


def action_label(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.ACTION_LABELS.items())
    return f"(CASE coalesce({x}, 'unknown') {cases} ELSE {x} END)"


def amendment(title: str) -> dict[str, str]:
    """SQL of action, point, clause, article and ``found`` for an amendment title."""
    folded = fold(title)
    shapes = []
    for patterns, groups in ((L._POINT_CLAUSE, (2, 3, 4)), (L._CLAUSE, (0, 2, 3)), (L._ARTICLE, (0, 0, 2))):
        for text, pattern in zip((title, folded), patterns):
            shapes.append((text, pattern, groups))
    out = {}
    for field, index in (("point", 0), ("clause", 1), ("article", 2)):
        cases = " ".join(
            f"WHEN {matches(t, p)} THEN {strip(group(t, p, g[index])) if g[index] else 'NULL'}" for t, p, g in shapes
        )
        out[field] = f"CASE {cases} END"
    cases = " ".join(f"WHEN {matches(t, p)} THEN {action(group(t, p, 1))}" for t, p, _ in shapes)
    out["action"] = (
        f"CASE {cases} WHEN {matches(folded, L._RENAME)} THEN 'rename' "
        f"WHEN {matches(folded, L._GENERIC)} THEN {action(title)} END"
    )
    return out


_UP = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)"
_BEFORE = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_AMEND = amendment("title")

CTES: dict[str, str] = {}


def _lines(source: str) -> str:
    return f"""SELECT doc_id, unnest(pieces) AS raw, generate_subscripts(pieces, 1) - 1 AS line_no
      FROM (SELECT doc_id, string_split({normalize('text')}, chr(10)) AS pieces FROM {source})"""


CTES["dirty"] = _per_line(I.DIRTY_LINE)
CTES["legal"] = _per_line(I.LEGAL_LINE)
CTES["plain_lines"] = (
    "SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS line_no "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)"
)
CTES["uploads"] = """SELECT source AS document_id, CAST(doc_id AS VARCHAR) AS version_id, doc_id AS upload_no,
  CASE WHEN doc_id % 13 <> 0 THEN 'documents/' || source || '/' || doc_id || '.txt' END AS source_file_path,
  CASE WHEN doc_id % 3 = 0 THEN 'documents/' || source || '/' || doc_id || '.txt.raw' END AS raw_text_path,
  CAST(NULL AS VARCHAR) AS cleaned_text_path, CAST(NULL AS VARCHAR) AS layout_json_path, 'pending' AS status
  FROM documents"""
CTES["versions"] = """SELECT document_id, version_id,
  row_number() OVER (PARTITION BY document_id ORDER BY upload_no) AS version_no,
  lag(version_id) OVER (PARTITION BY document_id ORDER BY upload_no) AS previous_version_id,
  source_file_path, raw_text_path, cleaned_text_path, layout_json_path, status FROM uploads"""
CTES["latest"] = "SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY version_no DESC) = 1"
CTES["document_table"] = """SELECT source AS document_id, 'Title ' || source AS title,
  CASE WHEN sum(doc_id) % 2 = 0 THEN 'web' END AS source_type, 'text/plain' AS mime_type, 'active' AS status
  FROM documents GROUP BY source HAVING sum(doc_id) % 7 <> 0"""
CTES["points"] = f"""SELECT e.vec_id AS id, e.embedding, e.label, CAST(e.vec_id % 20 AS VARCHAR) AS document_id,
  {I._KIND} AS chunk_kind, CASE WHEN label % 2 = 0 THEN 'true' ELSE 'false' END AS is_amendment,
  CAST(e.label AS VARCHAR) AS article_number, d.text, d.lang, d.source
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id"""
CTES["members"] = """SELECT label, 0 AS query_index, vec_id, embedding FROM embeddings
  UNION ALL SELECT label, vec_id % 2 + 1, vec_id, embedding FROM embeddings"""
CTES["query_dims"] = """SELECT label, query_index, d, avg(CAST(embedding[d] AS DOUBLE)) AS m
  FROM members, (SELECT unnest(generate_series(1, (SELECT max(len(embedding)) FROM embeddings))) AS d)
  GROUP BY label, query_index, d"""
CTES["query_vectors"] = """SELECT label AS query_id, query_index, list(m ORDER BY d) AS vector,
  label % 3 AS rule FROM query_dims GROUP BY label, query_index"""
CTES["scored"] = """SELECT q.query_id, q.query_index, p.id, p.chunk_kind, p.is_amendment,
  round(list_cosine_similarity(q.vector, CAST(p.embedding AS DOUBLE[])), 6) AS score, q.rule
  FROM query_vectors q, points p"""
CTES["hits"] = """SELECT query_id, query_index, id, score,
  row_number() OVER (PARTITION BY query_id, query_index ORDER BY score DESC, id) AS rank
  FROM scored QUALIFY rank <= 8"""
CTES["hits_20"] = """SELECT query_id, query_index, id, score,
  row_number() OVER (PARTITION BY query_id, query_index ORDER BY score DESC, id) AS rank
  FROM scored QUALIFY rank <= 20"""
CTES["filtered_hits"] = """SELECT query_id, query_index, id, score,
  row_number() OVER (PARTITION BY query_id, query_index ORDER BY score DESC, id) AS rank
  FROM scored WHERE rule = 0 OR (rule = 1 AND is_amendment = 'true') OR (rule = 2 AND chunk_kind = 'amendment')
  QUALIFY rank <= 8"""
CTES["unique_best"] = """SELECT query_id, id, score, query_index, rank, n AS matched_query_count FROM (
  SELECT *, count(*) OVER (PARTITION BY query_id, id) AS n,
    row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, query_index, rank) AS r FROM hits) WHERE r = 1"""
CTES["unique_first"] = """SELECT query_id, id, score, query_index, rank, n AS matched_query_count FROM (
  SELECT *, count(*) OVER (PARTITION BY query_id, id) AS n,
    row_number() OVER (PARTITION BY query_id, id ORDER BY query_index, rank) AS r FROM hits) WHERE r = 1"""
CTES["ranked"] = """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, query_index, rank, id)
  AS final_rank FROM unique_first QUALIFY final_rank <= 5"""
CTES["messages"] = """SELECT conv_id * 1000 + turn AS message_id, conv_id AS session_id, role, text AS content,
  1704067200 + conv_id * 1000 + turn * 10 AS created_at, turn FROM conversations"""
CTES["sessions"] = """SELECT session_id, session_id % 10 AS user_id,
  CASE WHEN session_id % 4 <> 0 THEN left(arg_min(content, turn), 40) END AS title,
  min(created_at) AS created_at, max(created_at) AS updated_at,
  CASE WHEN session_id % 9 = 0 THEN max(created_at) END AS deleted_at FROM messages GROUP BY session_id"""
CTES["traces"] = """SELECT m.message_id, CASE WHEN e.event_type <> 'signup' THEN e.event_type END AS route,
  CAST(trunc(e.value * 10) AS INTEGER) AS latency_ms
  FROM messages m JOIN events e ON e.event_id = (m.session_id * 10 + m.turn) % (SELECT count(*) FROM events)
  WHERE m.role = 'assistant'"""
CTES["feedback"] = """SELECT message_id * 10 + again AS feedback_id, message_id, session_id % 10 AS user_id,
  CASE WHEN again = 1 THEN 5 ELSE 1 + (session_id * 7 + turn * 3) % 5 END AS rating,
  CASE turn % 4 WHEN 1 THEN 'incorrect' WHEN 2 THEN 'outdated' WHEN 3 THEN 'unclear' END AS reason,
  CASE session_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'reviewed' ELSE 'resolved' END AS admin_status,
  CASE WHEN turn % 2 = 1 THEN 'seen' END AS admin_note, created_at + 5 AS created_at, again, session_id
  FROM messages, (VALUES (0), (1)) t(again) WHERE role = 'assistant' AND (again = 0 OR session_id % 10 = 0)"""
CTES["jobs"] = """SELECT user_id * 10 + event_id % 10 AS job_id, user_id AS document_id, event_id,
  CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed'
    ELSE 'completed' END AS status,
  event_id % 4 AS retry_count, ts, event_type = 'error' AS failed FROM events"""
CTES["job_rows"] = "SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1"
CTES["questions"] = f"""SELECT conv_id, turn, {duck_rule(I.QUESTION_TAIL)} AS question,
  {duck_rule(I.MODEL_ANSWER)} AS model_answer FROM conversations WHERE role = 'user'"""
CTES["records"] = f"""SELECT c_custkey // 50 AS doc_id, c_custkey,
  CASE WHEN c_custkey % 13 <> 0 THEN n_name END AS unit, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS name,
  CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS info,
  CASE WHEN c_custkey % 13 <> 0 THEN '0' || c_custkey END AS phone,
  CASE WHEN c_custkey % 13 <> 0 THEN replace(lower(c_name), '#', '.') || '@example.com' END AS email
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""
CTES["layout_rows"] = """SELECT doc_id, line_no, 0 AS half, line AS text, 500 AS width FROM plain_lines
  UNION ALL SELECT doc_id, line_no, 1, left(line, length(line) // 2), 250 FROM plain_lines"""

# --- segmentation of the legal texts ---------------------------------------------------

CTES["legal_raw"] = _lines("legal")
CTES["legal_lines"] = f"SELECT doc_id, line_no, raw, {parser_line('raw')} AS line FROM legal_raw"
CTES["events_of_lines"] = f"""SELECT *, CASE WHEN line IS NULL THEN 'N' WHEN {real_appendix('line')} THEN 'A'
  WHEN {matches('line', L.PART)} THEN 'P' WHEN {matches('line', L.CHAPTER)} THEN 'C'
  WHEN {matches('line', L.SECTION)} THEN 'S' WHEN {matches(fold('line'), L.AMENDMENT_TITLE)} THEN 'M'
  WHEN {matches('line', L.ARTICLE)} THEN 'R' ELSE 'X' END AS event FROM legal_lines"""
CTES["lasts"] = f"""SELECT *, coalesce(max(CASE WHEN event = 'A' THEN line_no END) {_BEFORE}, -1) AS la,
  coalesce(max(CASE WHEN event = 'R' THEN line_no END) {_BEFORE}, -1) AS lr,
  coalesce(max(CASE WHEN event IN ('P', 'C', 'S') THEN line_no END) {_BEFORE}, -1) AS lp,
  coalesce(max(CASE WHEN event = 'M' THEN line_no END) {_BEFORE}, -1) AS lm FROM events_of_lines"""
CTES["kinds"] = """SELECT *, CASE WHEN la > lr THEN 'appendix' WHEN lr < 0 OR lp > lr THEN 'none' ELSE 'article' END AS kb
  FROM lasts"""
CTES["runs"] = f"""SELECT *, event IN ('P', 'C', 'S') AND kb <> 'appendix' AS ctx,
  coalesce(max(CASE WHEN event = 'A' OR (event IN ('P', 'C', 'S') AND kb <> 'appendix')
    OR (event = 'R' AND kb = 'appendix') THEN line_no END) {_BEFORE}, -1) AS run FROM kinds"""
CTES["opened"] = """SELECT *, event = 'A' OR (event = 'R' AND NOT (kb = 'article' AND lm > run)) AS opens FROM runs"""
CTES["blocks_of_lines"] = f"""SELECT *, NOT opens AND NOT ctx AND event <> 'N' AND kb <> 'none' AS content,
  count(CASE WHEN opens THEN 1 END) {_UP} AS block_id,
  max(CASE WHEN ctx AND event = 'P' THEN line_no END) {_UP} AS part_at,
  max(CASE WHEN ctx AND event = 'C' THEN line_no END) {_UP} AS chapter_at,
  max(CASE WHEN ctx AND event = 'S' THEN line_no END) {_UP} AS section_at,
  max(CASE WHEN event = 'A' OR (ctx AND event = 'P') THEN line_no END) {_UP} AS reset_c,
  max(CASE WHEN event = 'A' OR (ctx AND event IN ('P', 'C')) THEN line_no END) {_UP} AS reset_s FROM opened"""
CTES["openers"] = f"""SELECT o.doc_id, o.block_id, CASE WHEN o.event = 'A' THEN 'appendix' ELSE 'article' END AS kind,
  o.line AS title, nullif(CASE WHEN o.event = 'A' THEN {group('o.line', L.APPENDIX, 1)}
    ELSE {group('o.line', L.ARTICLE, 1)} END, '') AS number,
  p.line AS part_title, c.line AS chapter_title, s.line AS section_title
  FROM blocks_of_lines o
  LEFT JOIN legal_lines p ON p.doc_id = o.doc_id AND p.line_no = o.part_at
  LEFT JOIN legal_lines c ON c.doc_id = o.doc_id AND c.line_no = o.chapter_at AND o.chapter_at > coalesce(o.reset_c, -1)
  LEFT JOIN legal_lines s ON s.doc_id = o.doc_id AND s.line_no = o.section_at AND o.section_at > coalesce(o.reset_s, -1)
  WHERE o.opens"""
CTES["block_rows"] = """SELECT b.doc_id, b.block_id, o.kind, o.title, o.number, o.part_title, o.chapter_title,
  o.section_title, string_agg(b.line, chr(10) ORDER BY b.line_no) AS content
  FROM blocks_of_lines b JOIN openers o USING (doc_id, block_id) WHERE b.content GROUP BY ALL"""
CTES["kept_lines"] = f"""SELECT b.doc_id, b.line_no, b.raw, b.line, b.has_block,
  CASE WHEN b.has_block THEN b.block_id ELSE 0 END AS block_id,
  CASE WHEN b.has_block THEN o.kind ELSE 'none' END AS kind,
  CASE WHEN b.has_block THEN {parser_line('b.line')} ELSE b.line END AS line2
  FROM (SELECT *, bool_or(content) OVER (PARTITION BY doc_id) AS has_block FROM blocks_of_lines) b
  LEFT JOIN openers o ON o.doc_id = b.doc_id AND o.block_id = b.block_id
  WHERE b.content OR NOT b.has_block"""
CTES["marked_lines"] = f"""SELECT *, coalesce({matches(fold('line2'), L.AMENDMENT_TITLE)}, false) AS is_m,
  coalesce({matches(fold('line2'), L.FREE_FORM)}, false) AS is_f,
  {accepted('line2', 'roman', 'numbered', 'clause')} AS hk, {inner_number('line2')} AS hn, {inner_level('line2')} AS hl
  FROM kept_lines"""
_BLK = "OVER (PARTITION BY doc_id, block_id)"
CTES["branched"] = rf"""SELECT *, CASE
  WHEN kind = 'article' AND bool_or(is_m) {_BLK} THEN 'numbered'
  WHEN kind = 'article' AND bool_or(is_f) {_BLK} THEN 'free'
  WHEN kind = 'article' AND sum(length(regexp_replace(line, '[ \t]+', ' ', 'g')) + 1) {_BLK} - 1 > 4500
    AND count(CASE WHEN hk = 'clause' THEN 1 END) {_BLK} > 1 THEN 'clause'
  WHEN kind = 'article' THEN 'article'
  WHEN kind = 'appendix' AND count(hk) {_BLK} > 0 THEN 'appendix_item' WHEN kind = 'appendix' THEN 'appendix'
  WHEN count(hk) {_BLK} > 0 THEN 'section' ELSE 'unknown' END AS branch FROM marked_lines"""
CTES["started"] = """SELECT *, coalesce(CASE branch WHEN 'numbered' THEN is_m WHEN 'free' THEN is_f
  WHEN 'clause' THEN hk = 'clause' WHEN 'appendix_item' THEN hk IS NOT NULL WHEN 'section' THEN hk IS NOT NULL
  ELSE false END, false) AS starts FROM branched"""
CTES["itemed"] = """SELECT *, CASE WHEN branch IN ('clause', 'appendix_item', 'section') THEN greatest(n, 1) ELSE n END AS item,
  CASE WHEN branch IN ('numbered', 'free', 'clause', 'appendix_item', 'section') THEN line2
    WHEN branch = 'unknown' THEN raw ELSE line END AS text
  FROM (SELECT *, count(CASE WHEN starts THEN 1 END) OVER (PARTITION BY doc_id, block_id ORDER BY line_no
    ROWS UNBOUNDED PRECEDING) AS n FROM started)
  WHERE NOT (branch IN ('numbered', 'free') AND n = 0)"""
_ITM = "OVER (PARTITION BY doc_id, block_id, item)"
CTES["item_rows"] = f"""SELECT *, max(CASE WHEN starts THEN line2 END) {_ITM} AS item_title,
  max(CASE WHEN starts THEN hn END) {_ITM} AS item_number, max(CASE WHEN starts THEN hl END) {_ITM} AS item_level,
  coalesce(sum(CASE WHEN NOT starts THEN length(text) + 1 END) {_ITM} - 1, 0) AS item_chars
  FROM itemed WHERE text IS NOT NULL"""
CTES["sub_marks"] = f"""SELECT *, CASE WHEN is_long AND NOT starts THEN {accepted('line3', 'point', 'bullet')} END AS sk,
  {inner_number('line3')} AS sn, {inner_level('line3')} AS sl FROM (
  SELECT *, branch = 'appendix_item' AND item_chars > 4500 AS is_long, {parser_line('text')} AS line3 FROM item_rows)"""
CTES["sub_rows"] = """SELECT *, CASE WHEN has_sub THEN greatest(ns, 1) ELSE 0 END AS sub FROM (
  SELECT *, count(sk) OVER (PARTITION BY doc_id, block_id, item) > 0 AS has_sub,
    count(sk) OVER (PARTITION BY doc_id, block_id, item ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS ns FROM sub_marks)
  WHERE NOT (has_sub AND (starts OR line3 IS NULL))"""
CTES["grouped_items"] = """SELECT doc_id, block_id, item, sub, min(branch) AS branch, min(item_title) AS item_title,
  min(item_number) AS item_number, min(item_level) AS item_level,
  max(CASE WHEN sk IS NOT NULL THEN line3 END) AS sub_title, max(CASE WHEN sk IS NOT NULL THEN sn END) AS sub_number,
  max(CASE WHEN sk IS NOT NULL THEN sl END) AS sub_level,
  string_agg(CASE WHEN NOT (starts OR sk IS NOT NULL) THEN CASE WHEN has_sub THEN line3 ELSE text END END, chr(10)
    ORDER BY line_no) AS body
  FROM sub_rows GROUP BY doc_id, block_id, item, sub"""
_FALLBACK = (
    "coalesce(left((list_filter(list_transform(string_split(body, chr(10)), "
    f"lambda z: {parser_line('z')}), lambda z: z IS NOT NULL))[1], 180), 'Untitled')"
)
CTES["pathed"] = f"""SELECT g.*, o.kind, o.title AS block_title, o.number AS block_number, o.part_title,
  o.chapter_title, o.section_title,
  CASE WHEN branch IN ('clause', 'appendix_item') THEN concat_ws(' > ', o.title, item_title, sub_title)
    WHEN branch = 'section' THEN item_title WHEN branch IN ('article', 'appendix') THEN o.title END AS path,
  {normalize("CASE WHEN branch IN ('numbered', 'free') THEN coalesce(body, '') ELSE coalesce(body, sub_title, item_title) END")}
    AS content
  FROM grouped_items g LEFT JOIN openers o ON o.doc_id = g.doc_id AND o.block_id = g.block_id AND g.block_id > 0"""
CTES["titled"] = f"""SELECT *, {collapse(f"CASE WHEN branch IN ('numbered', 'free') THEN item_title WHEN branch = 'unknown' THEN {_FALLBACK} ELSE path END")}
  AS title FROM pathed"""
CTES["parsed"] = f"""SELECT doc_id, block_id, item, sub,
  CASE WHEN branch IN ('numbered', 'free') THEN 'amendment' WHEN branch IN ('clause', 'article') THEN 'article'
    WHEN branch IN ('appendix', 'appendix_item') THEN 'appendix' WHEN branch = 'section' THEN 'section'
    ELSE 'unknown' END AS chunk_kind, branch, title, content, part_title,
  CASE WHEN kind = 'article' THEN chapter_title END AS chapter_title,
  CASE WHEN kind = 'article' THEN section_title END AS section_title,
  CASE WHEN kind = 'appendix' THEN block_title END AS appendix_title,
  CASE WHEN kind = 'appendix' THEN block_number END AS appendix_number,
  CASE WHEN kind = 'article' THEN block_title END AS article_title,
  CASE WHEN kind = 'article' THEN block_number END AS article_number,
  CASE WHEN branch IN ('clause', 'appendix_item', 'section') THEN
    CASE WHEN sub > 0 THEN coalesce(sub_level, item_level) ELSE item_level END END AS heading_level,
  CASE WHEN branch IN ('clause', 'appendix_item', 'section') THEN
    CASE WHEN sub > 0 AND sub_level IS NOT NULL THEN sub_number ELSE item_number END END AS heading_number,
  CASE WHEN branch NOT IN ('numbered', 'free') THEN path END AS section_path,
  CASE WHEN branch = 'numbered' THEN {group('item_title', L.AMENDMENT_ITEM, 1)} END AS order_number,
  CASE WHEN branch IN ('numbered', 'free') THEN {_AMEND['action']} END AS action,
  CASE WHEN branch IN ('numbered', 'free') THEN {_AMEND['article']} END AS target_article_number,
  CASE WHEN branch IN ('numbered', 'free') THEN {_AMEND['clause']} END AS target_clause_text,
  CASE WHEN branch IN ('numbered', 'free') THEN {_AMEND['point']} END AS target_point_text
  FROM titled
  WHERE content <> '' AND (branch NOT IN ('numbered', 'free') OR ({_AMEND['action']}) IS NOT NULL)"""
# The greedy merge of small sections is a recursion over the chunks of a document.
CTES["seq"] = """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_id, item, sub) AS pos FROM parsed"""
CTES["fold_steps"] = """SELECT doc_id, pos, 1 AS grp, chunk_kind = 'section' AS sec, heading_level AS lvl,
    length(content) AS chars FROM seq WHERE pos = 1
  UNION ALL
  SELECT s.doc_id, s.pos, CASE WHEN m THEN f.grp ELSE f.grp + 1 END, s.chunk_kind = 'section',
    CASE WHEN m THEN f.lvl ELSE s.heading_level END,
    CASE WHEN m THEN f.chars + CASE WHEN length(s.title) > 0 THEN length(s.title) + 3 ELSE 2 END + length(s.content)
      ELSE length(s.content) END
  FROM fold_steps f JOIN seq s ON s.doc_id = f.doc_id AND s.pos = f.pos + 1,
  LATERAL (SELECT f.sec AND s.chunk_kind = 'section' AND coalesce(s.heading_level, 0) <> 1
    AND (f.lvl IS NULL OR s.heading_level IS NULL OR s.heading_level >= f.lvl)
    AND f.chars + length(s.content) + length(s.title) + 2 <= 4500 AND f.chars < 900 AS m) x"""
CTES["merged"] = f"""SELECT h.* EXCLUDE (content, section_path, pos),
  CASE WHEN t.parts > 1 THEN {normalize('t.merged')} ELSE h.content END AS content, t.path AS section_path
  FROM (SELECT s.doc_id, f.grp, min(s.pos) AS first_pos, count(*) AS parts,
      string_agg(CASE WHEN s.pos = g0.p0 THEN s.content ELSE concat_ws(chr(10), nullif(s.title, ''), s.content) END,
        chr(10) || chr(10) ORDER BY s.pos) AS merged,
      string_agg(s.section_path, ' > ' ORDER BY s.pos) AS path
    FROM seq s JOIN fold_steps f USING (doc_id, pos)
      JOIN (SELECT doc_id, grp, min(pos) AS p0 FROM fold_steps GROUP BY doc_id, grp) g0 ON g0.doc_id = f.doc_id AND g0.grp = f.grp
    GROUP BY s.doc_id, f.grp) t JOIN seq h ON h.doc_id = t.doc_id AND h.pos = t.first_pos"""
CTES["numbered_chunks"] = """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_id, item, sub) - 1 AS chunk_index,
  count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM merged"""


def with_ctes(body: str) -> str:
    """The query with the CTEs it uses, in definition order."""
    needed: list[str] = []
    text = body
    for name in reversed(CTES):
        if re.search(rf"\b{name}\b", text):
            needed.append(name)
            text += " " + CTES[name]
    if not needed:
        return body
    recursive = "RECURSIVE " if "fold_steps" in needed else ""
    defs = ",\n".join(f"{n} AS ({CTES[n]})" for n in reversed(needed))
    return f"WITH {recursive}{defs}\n{body}"
