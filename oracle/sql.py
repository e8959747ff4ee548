"""DuckDB twins of the registered queries."""

from __future__ import annotations

from lawloom.functions import legal as L
from lawloom.functions import text as T
from lawloom.operators import chunks as C
from lawloom.operators import conversations as A
from lawloom.operators import layout as Y
from lawloom.operators import routing as Q
from lawloom.operators import versions as V
from oracle.ctes import (
    CTES, accepted, action, action_label, collapse, false_heading, fold, group, inner_kind, inner_level, inner_number,
    keyword_text, matches, normalize, parser_line, real_appendix, rx, strip, with_ctes,
)

ORACLE: dict[str, str] = {}
NL = "chr(10)"


def add(name: str, sql: str) -> None:
    ORACLE[name] = with_ctes(sql)


# --- text ------------------------------------------------------------------------------

_newlines = r"regexp_replace(text, '\r\n?', chr(10), 'g')"
_spaces = lambda x: f"regexp_replace({x}, '[ \\t' || chr(160) || ']+', ' ', 'g')"
_pystrip = lambda x: rf"regexp_replace({x}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')"

add("txt_1_newlines", f"SELECT doc_id, {_newlines} AS text FROM dirty")
add("txt_2_spaces", f"SELECT doc_id, {_spaces('text')} AS text FROM dirty")
CTES["dirty_stripped"] = f"""SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS line_no
  FROM (SELECT doc_id, string_split({_newlines}, chr(10)) AS p FROM dirty)"""
CTES["dirty_lines"] = f"SELECT doc_id, line_no, {_pystrip('raw')} AS line FROM dirty_stripped"
CTES["spaced_lines"] = f"SELECT doc_id, line_no, {strip(_spaces('raw'))} AS line FROM dirty_stripped"
add("txt_3_stripped_lines", "SELECT doc_id, line_no, line FROM dirty_lines")
add(
    "txt_4_extra_blank_lines",
    """SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM (
    SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM dirty_lines)
    WHERE NOT (line = '' AND coalesce(before = '', false)) GROUP BY doc_id""",
)
_heading = matches("line", T.CLEAN_HEADING)
_bullet = matches("line", T.CLEAN_BULLET)
CTES["glue"] = f"""SELECT *, (before IS NULL OR line = '' OR {_heading} OR {_bullet} OR before = ''
  OR {matches('before', T.CLEAN_HEADING)} OR regexp_matches(before, '[.:;?!]$')) AS starts FROM (
  SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM spaced_lines)"""
CTES["glued"] = """SELECT doc_id, g, string_agg(line, ' ' ORDER BY line_no) AS line FROM (
  SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM glue)
  GROUP BY doc_id, g"""
add("txt_5_merged_lines", "SELECT doc_id, string_agg(line, chr(10) ORDER BY g) AS text FROM glued GROUP BY doc_id")
CTES["legal_plain"] = """SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS line_no
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM legal)"""
add("txt_6_headings", f"SELECT doc_id, line_no, {_heading} AS heading, {_bullet} AS bullet FROM legal_plain")
_clean = strip(r"regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g')")
CTES["cleaned"] = f"""SELECT doc_id, {_clean} AS text FROM (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY g) AS t FROM glued GROUP BY doc_id)"""
add("txt_7_clean", "SELECT doc_id, text FROM cleaned")
add("txt_8_fold", f"SELECT doc_id, {fold('text')} AS folded, {collapse(fold('text'))} AS collapsed FROM legal")
add("txt_9_keyword_text", f"SELECT doc_id, {keyword_text('text')} AS text FROM dirty")
_no_nbsp = "SELECT doc_id, replace(text, chr(160), ' ') AS t FROM dirty"
_norm_text = normalize(r"regexp_replace(t, '\r\n?', chr(10), 'g')")
add("txt_10_parser_text", f"SELECT doc_id, {_norm_text} AS text, {collapse('t')} AS line FROM ({_no_nbsp})")
add(
    "txt_12_footnotes",
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^2\. ', '2.8 Đối với ', 'g'),
    '(?mi)^(\s*\d+)\.\d{1,2}\s+((?:FOOT)(?:[^\p{L}\p{N}_]|$))', '\1. \2', 'g') AS text FROM legal""".replace(
        "FOOT", T.FOOTNOTE_WORDS
    ),
)
_visible = r"""regexp_replace(regexp_replace(regexp_replace(B,
  '(?is)<!--.*?-->|<!doctype[^>]*>|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<template\b[^>]*>.*?</template>',
  chr(3), 'g'), '(?s)<[/a-zA-Z!][^>]*>', chr(3), 'g'), '^$', '')"""
_decode = "replace(replace(replace(replace(X, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
_shown = (
    f"array_to_string(list_filter(list_transform(string_split({_visible.replace('B', 'z')}, chr(3)), "
    f"lambda w: {strip(_decode.replace('X', 'w'))}), lambda w: w <> ''), ' ')"
)
add(
    "txt_14_html_blocks",
    rf"""SELECT page_id, regexp_replace(array_to_string(list_transform(pieces, lambda z, i: CASE WHEN i % 2 = 0 THEN
      CASE WHEN {_shown} = '' THEN chr(10) ELSE chr(10) || {_shown} || chr(10) END ELSE z END), ''),
      '(?i)</?(?:span|strong|b|i|em|u)\b[^>]*>', '', 'g') AS text FROM (
    SELECT page_id, string_split(replace(regexp_replace(html,
      '(?is)(<(?:div|p|center|h[1-6])\b[^>]*>.*?</(?:div|p|center|h[1-6])>)', chr(1) || '\1' || chr(2), 'g'),
      chr(2), chr(1)), chr(1)) AS pieces FROM pages)""",
)
_kept = f"list_filter(list_transform(string_split(t, chr(10)), lambda z: {parser_line('z')}), lambda z: z IS NOT NULL)"
add(
    "txt_18_parser_lines",
    f"""SELECT doc_id, coalesce(left(({_kept})[1], 180), 'Untitled') AS title, array_to_string({_kept}, chr(10)) AS text
    FROM (SELECT doc_id, {_norm_text} AS t FROM ({_no_nbsp}))""",
)
add(
    "txt_19_previews",
    f"""SELECT conv_id, turn, CASE WHEN text <> '' THEN left({collapse('text')}, 160) END AS preview,
    left({collapse('text')}, 80) AS generated, nullif(left({strip('text')}, 255), '') AS title FROM conversations""",
)

# --- structure ---------------------------------------------------------------------------

_cases = " ".join(f"WHEN {matches('line', p)} THEN '{lvl}'" for lvl, p in L.SECTION_KEYWORDS)
_nums = " ".join(f"WHEN {matches('line', p)} THEN {group('line', p, 2)}" for _, p in L.SECTION_KEYWORDS)
add(
    "str_1_section_headings",
    f"""SELECT * FROM (SELECT doc_id, line_no AS line_index, CASE {_cases} END AS level, CASE {_nums} END AS number,
    line AS title FROM (SELECT doc_id, line_no, {strip('line')} AS line FROM legal_plain)) WHERE level IS NOT NULL""",
)
add("str_2_major_blocks", "SELECT * FROM block_rows")
add("str_3_appendix_headings", f"SELECT doc_id, line_no, {real_appendix('line')} AS real FROM legal_lines WHERE line IS NOT NULL")
add(
    "str_4_inner_headings",
    f"""SELECT * FROM (SELECT doc_id, line_no, {inner_kind('line')} AS kind, {inner_number('line')} AS number,
    {inner_level('line')} AS level FROM legal_lines WHERE line IS NOT NULL) WHERE kind IS NOT NULL""",
)
add(
    "str_5_false_headings",
    f"""SELECT doc_id, line_no, {false_heading('line', 'kind')} AS rejected FROM (
    SELECT *, {inner_kind('line')} AS kind FROM legal_lines WHERE line IS NOT NULL) WHERE kind IS NOT NULL""",
)


def heading_items(lines: str, keys: str, *kinds: str) -> str:
    return f"""SELECT {keys}, item, max(CASE WHEN k IS NOT NULL THEN line END) AS title,
      max(CASE WHEN k IS NOT NULL THEN {inner_number('line')} END) AS number,
      max(CASE WHEN k IS NOT NULL THEN {inner_level('line')} END) AS level,
      coalesce(string_agg(CASE WHEN k IS NULL THEN line END, chr(10) ORDER BY line_no),
        max(CASE WHEN k IS NOT NULL THEN line END)) AS content
    FROM (SELECT *, greatest(count(k) OVER (PARTITION BY {keys} ORDER BY line_no ROWS UNBOUNDED PRECEDING), 1) AS item,
        count(k) OVER (PARTITION BY {keys}) AS n
      FROM (SELECT {keys}, line_no, line, {accepted('line', *kinds)} AS k FROM {lines} WHERE line IS NOT NULL))
    WHERE n > 0 GROUP BY {keys}, item"""


def in_blocks(kind: str) -> str:
    return (
        "(SELECT b.doc_id, b.block_id, b.line_no, b.line FROM blocks_of_lines b JOIN openers o "
        f"USING (doc_id, block_id) WHERE b.content AND o.kind = '{kind}')"
    )


_items_sql = heading_items("legal_lines", "doc_id", "roman", "numbered", "clause").replace(
    "AS content", "AS content"
)
add("str_6_heading_items", f"SELECT doc_id, title, number, level, content, item FROM ({_items_sql})")
add(
    "str_7_article_blocks",
    """SELECT doc_id, block_id, item, chunk_kind, title, content, article_number, section_path FROM parsed
    WHERE chunk_kind IN ('article', 'amendment')""",
)
_clauses = heading_items(in_blocks("article"), "doc_id, block_id", "clause")
add(
    "str_8_article_clauses",
    f"SELECT * FROM ({_clauses}) QUALIFY count(*) OVER (PARTITION BY doc_id, block_id) > 1",
)
add(
    "str_9_appendix_blocks",
    """SELECT doc_id, block_id, item, sub, title, content, appendix_title, appendix_number, heading_level,
    heading_number FROM parsed WHERE chunk_kind = 'appendix'""",
)
add(
    "str_10_generic_blocks",
    heading_items(in_blocks("appendix"), "doc_id, block_id", "roman", "numbered", "clause", "point"),
)


def amendment_items(starts: str, closes: str) -> str:
    w = "OVER (PARTITION BY doc_id, block_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT doc_id, block_id, item, max(CASE WHEN starts THEN line END) AS title,
      max(CASE WHEN starts THEN nullif({group('line', L.AMENDMENT_ITEM, 1)}, '') END) AS order_number,
      coalesce(string_agg(CASE WHEN NOT starts THEN line END, chr(10) ORDER BY line_no), '') AS content
    FROM (SELECT *, count(CASE WHEN starts THEN 1 END) {w} AS item,
        max(CASE WHEN starts THEN line_no END) {w} > coalesce(max(CASE WHEN closes AND NOT starts THEN line_no END) {w}, -1) AS is_open
      FROM (SELECT *, {starts} AS starts, {closes} AS closes FROM {in_blocks('article')}))
    WHERE item > 0 AND is_open GROUP BY doc_id, block_id, item"""


_m, _f = matches(fold("line"), L.AMENDMENT_TITLE), matches(fold("line"), L.FREE_FORM)
add("str_11_numbered_amendments", amendment_items(_m, "false"))
add("str_12_free_form_amendments", amendment_items(_f, _m))
add(
    "str_13_amendment_targets",
    """SELECT doc_id, block_id, item, title, action, target_article_number, target_clause_text, target_point_text,
    order_number FROM parsed WHERE chunk_kind = 'amendment'""",
)
add(
    "str_14_actions",
    f"""SELECT action, {action_label('action')} AS label, count(*) AS n FROM (
    SELECT {action('line')} AS action FROM legal_lines WHERE line IS NOT NULL) GROUP BY action""",
)
# The value that is missing its end label runs to the end of the block; the inputs lack a name or all but the name.
CTES["fields"] = rf"""SELECT *, name IS NULL AND unit IS NULL AS empty FROM records"""
CTES["record_rows"] = """SELECT doc_id, c_custkey, unit AS raw_unit,
  CASE WHEN name IS NULL AND unit IS NOT NULL
    THEN 'Đơn vị: ' || unit || ' Thông tin: ' || info || ' Điện thoại: ' || phone || ' Email: ' || email END AS unnamed,
  CASE WHEN unit IS NOT NULL AND name IS NULL
    THEN unit || ' Thông tin: ' || info || ' Điện thoại: ' || phone || ' Email: ' || email ELSE unit END AS unit,
  name, info, phone, email FROM fields WHERE NOT empty"""
CTES["valid_rows"] = "SELECT * FROM record_rows WHERE name IS NOT NULL AND unit IS NOT NULL"
add("str_16_directory_fields", "SELECT doc_id, unit, name, info, phone, email FROM record_rows")
add("str_17_valid_records", "SELECT doc_id, unit, name, info, phone, email FROM valid_rows")
CTES["units"] = f"""SELECT doc_id, unit AS lecturer_unit, count(*) AS people,
  'Đơn vị: ' || unit || chr(10) || 'Số lượng giảng viên/cán bộ: ' || count(*) || chr(10) || chr(10) ||
  string_agg(n || '. Tên: ' || name || chr(10) || ' Thông tin: ' || info || chr(10) || ' Điện thoại: ' || phone
    || chr(10) || ' Email: ' || email, chr(10) || chr(10) ORDER BY c_custkey) AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY c_custkey) AS n FROM valid_rows)
  GROUP BY doc_id, unit"""
add(
    "str_15_directory_units",
    """SELECT doc_id, 'Thông tin giảng viên: ' || lecturer_unit AS title, content,
    'Thông tin giảng viên > ' || lecturer_unit AS section_path, lecturer_unit, people FROM units""",
)
add("str_18_unit_content", "SELECT doc_id, lecturer_unit, length(content) AS chars, content FROM units")
add(
    "str_19_numbered_headings",
    "SELECT doc_id, item, title, content, heading_level, heading_number FROM parsed WHERE chunk_kind = 'section'",
)
add(
    "str_20_parsed_documents",
    """SELECT doc_id, chunk_index, total_chunks, chunk_kind, title, content, part_title, chapter_title, section_title,
    appendix_number, article_number, section_path, action, target_article_number FROM numbered_chunks""",
)
add(
    "str_21_post_processed",
    """SELECT chunk_kind, count(*) AS n, sum(length(title))::BIGINT AS title_chars, sum(length(content))::BIGINT AS chars,
    min(length(content)) AS shortest FROM parsed GROUP BY chunk_kind""",
)
add(
    "str_22_merged_sections",
    """SELECT doc_id, chunk_index, total_chunks, title, content, section_path FROM numbered_chunks
    WHERE chunk_kind = 'section'""",
)
CTES["line_keys"] = f"SELECT doc_id, line_no, {fold(collapse('line'))} AS lf FROM plain_lines"
CTES["entry_keys"] = f"SELECT doc_id, line_no AS at, width, {fold(collapse('text'))} AS ef FROM layout_rows"
CTES["line_boxes"] = f"""SELECT DISTINCT l.doc_id, l.line_no, '0.0,' || (e.at % 10 * 10) || '.0,' || e.width || '.0,'
    || (e.at % 10 * 10 + 9) || '.0' AS bbox, e.at // 10 AS page_idx
  FROM line_keys l JOIN entry_keys e ON e.doc_id = l.doc_id AND length(l.lf) >= {Y.MIN_LINE}
    AND length(e.ef) >= {Y.MIN_ENTRY} AND (e.ef = l.lf OR (length(l.lf) >= {Y.MIN_CONTAINED} AND contains(e.ef, l.lf))
    OR (length(e.ef) >= {Y.MIN_CONTAINED} AND contains(l.lf, e.ef)))"""
add("str_23_line_layout", "SELECT doc_id, line_no, bbox, page_idx FROM line_boxes")
add(
    "str_24_layout_payload",
    """SELECT doc_id, unit, count(DISTINCT bbox || '@' || page_idx) AS boxes,
    array_to_string(list_sort(list_distinct(list(page_idx))), ',') AS pages, count(DISTINCT page_idx) AS sized_pages
    FROM (SELECT *, line_no // 7 AS unit FROM line_boxes) GROUP BY doc_id, unit""",
)
_lab = action_label("action")
_amended = "chunk_kind = 'amendment' AND target_article_number <> ''"
CTES["chunk_rows"] = f"""SELECT c.*, CAST(c.doc_id AS VARCHAR) AS version_id,
  sha256(c.doc_id || '|' || c.doc_id || '|' || c.chunk_index) AS chunk_id,
  CASE WHEN {_amended} AND target_clause_text <> ''
    THEN {_lab} || ' khoản ' || target_clause_text || ', Điều ' || target_article_number
    WHEN {_amended} THEN {_lab} || ' Điều ' || target_article_number ELSE title END AS chunk_title,
  CASE chunk_kind WHEN 'amendment' THEN 'regulation_amendment' WHEN 'article' THEN 'regulation'
    WHEN 'section' THEN 'document_section' ELSE 'document_chunk' END AS chunk_type,
  CASE WHEN chunk_kind = 'amendment' THEN concat_ws(' > ', 'Văn bản sửa đổi/bổ sung',
      'Điều chứa nội dung sửa đổi ' || nullif(article_number, ''), 'Điều được tác động ' || nullif(target_article_number, ''),
      'Khoản ' || nullif(target_clause_text, ''), {_lab})
    ELSE concat_ws(' > ', part_title, CASE WHEN chapter_title IS DISTINCT FROM part_title THEN chapter_title END,
      CASE WHEN section_title IS DISTINCT FROM coalesce(chapter_title, part_title) THEN section_title END,
      CASE WHEN {strip("coalesce(nullif(section_path, ''), title)")} IS DISTINCT FROM coalesce(section_title, chapter_title, part_title)
        THEN nullif({strip("coalesce(nullif(section_path, ''), title)")}, '') END) END AS chunk_path
  FROM numbered_chunks c"""
_body = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.AMENDMENT_BODY.items())
CTES["chunk_texts"] = f"""SELECT *, CASE chunk_kind
  WHEN 'amendment' THEN concat_ws(chr(10), head, 'Loại chunk: Nội dung sửa đổi/bổ sung/bãi bỏ', 'Loại thay đổi: ' || {_lab},
    'Điều chứa nội dung sửa đổi: ' || nullif(article_title, ''), 'Điều được tác động: Điều ' || nullif(target_article_number, ''),
    'Khoản được tác động: ' || nullif(target_clause_text, ''), 'Tiêu đề nội dung sửa đổi: ' || title,
    CASE action {_body} ELSE 'Nội dung:' END, content)
  WHEN 'article' THEN concat_ws(chr(10), head, 'Loại chunk: Điều trong văn bản', 'Chương: ' || nullif(chapter_title, ''),
    'Mục: ' || nullif(section_title, ''), 'Điều: ' || nullif(article_title, ''), 'Nội dung:', content)
  WHEN 'section' THEN concat_ws(chr(10), head, 'Loại chunk: Mục nội dung', 'Số mục: ' || nullif(heading_number, ''),
    'Cấp mục: ' || heading_level, 'Mục cha: ' || nullif(section_title, ''), 'Tiêu đề mục: ' || title, 'Nội dung:', content)
  ELSE concat_ws(chr(10), head, 'Loại chunk: ' || chunk_kind, 'Tiêu đề: ' || title, 'Nội dung:', content) END AS chunk_text
  FROM (SELECT *, 'Tài liệu: Document ' || doc_id AS head FROM chunk_rows)"""
# Pages and boxes: every line of a legal text lies on a page of ten lines; lines of blocks and items are matched to them.
CTES["unit_lines"] = f"""SELECT doc_id, block_id, CAST(NULL AS BIGINT) AS item, line
  FROM (SELECT *, bool_or(content) OVER (PARTITION BY doc_id) AS has_block FROM blocks_of_lines)
  WHERE has_block AND (opens OR content) AND line IS NOT NULL
  UNION ALL SELECT doc_id, 0, item, CASE WHEN branch = 'section' THEN {parser_line('line')} ELSE line END
  FROM itemed WHERE NOT has_block AND line IS NOT NULL"""
CTES["unit_keys"] = f"SELECT DISTINCT doc_id, block_id, item, {fold(collapse('line'))} AS lf FROM unit_lines"
CTES["legal_entries"] = f"SELECT doc_id, line_no AS at, {fold(collapse('line'))} AS ef FROM legal_plain"
CTES["unit_boxes"] = """SELECT DISTINCT u.doc_id, u.block_id, u.item, e.at % 10 * 10 AS y, e.at // 10 AS page
  FROM unit_keys u JOIN legal_entries e ON e.doc_id = u.doc_id AND length(u.lf) >= 10 AND length(e.ef) >= 8
    AND (e.ef = u.lf OR (length(u.lf) >= 20 AND contains(e.ef, u.lf)) OR (length(e.ef) >= 20 AND contains(u.lf, e.ef)))"""
CTES["chunk_items"] = """SELECT s.doc_id, s.item, first_value(s.item) OVER (PARTITION BY s.doc_id, f.grp ORDER BY s.pos) AS head
  FROM seq s JOIN fold_steps f USING (doc_id, pos) WHERE s.block_id = 0"""
CTES["chunk_boxes"] = """SELECT b.doc_id, b.block_id, c.head AS item, b.y, b.page
  FROM unit_boxes b JOIN chunk_items c ON c.doc_id = b.doc_id AND c.item = b.item WHERE b.block_id = 0
  UNION SELECT doc_id, block_id, NULL, y, page FROM unit_boxes WHERE block_id > 0"""
CTES["chunk_pages"] = """SELECT doc_id, block_id, item, min(page) + 1 AS page_start, max(page) + 1 AS page_end,
  string_agg('0.0,' || y || '.0,500.0,' || (y + 9) || '.0@' || page, '|' ORDER BY page, y) AS bboxes,
  array_to_string(list_transform(list_sort(list_distinct(list(page))), lambda p: p || ':595.0x842.0'), ',') AS page_sizes,
  array_to_string(list_sort(list_distinct(list(page))), ',') AS page_indices
  FROM chunk_boxes GROUP BY doc_id, block_id, item"""
CTES["paged_chunks"] = """SELECT c.*, p.page_start, p.page_end, p.bboxes, p.page_sizes, coalesce(p.page_indices, '') AS page_indices
  FROM chunk_rows c LEFT JOIN chunk_pages p ON p.doc_id = c.doc_id AND p.block_id = c.block_id
    AND p.item IS NOT DISTINCT FROM (CASE WHEN c.block_id = 0 THEN c.item END)"""
add(
    "str_25_chunk_rows",
    """SELECT chunk_id, doc_id AS document_id, version_id, chunk_index, total_chunks, page_start AS page_number, page_end
    FROM paged_chunks""",
)
add(
    "str_26_chunk_paths",
    """SELECT doc_id AS document_id, chunk_index, chunk_type, chunk_title AS title, chunk_path AS section_path
    FROM chunk_rows""",
)
add("str_27_chunk_texts", "SELECT doc_id AS document_id, chunk_index, chunk_text FROM chunk_texts")

# --- sources and sinks ---------------------------------------------------------------------

add(
    "src_1_text_files",
    f"SELECT item_id, 'txt' AS source_type, {strip('text')} AS raw_text, length({strip('text')}) AS char_count FROM benchmark",
)
add(
    "src_2_corpus_scan",
    """SELECT doc_id || '.' || x AS file_name, lower(x) AS suffix, octet_length(encode(text)) AS bytes, x <> 'dat' AS supported,
    CASE WHEN x <> 'dat' THEN text END AS raw_text
    FROM (SELECT *, (['txt', 'md', 'RST', 'dat'])[doc_id % 4 + 1] AS x FROM documents WHERE text <> '')""",
)
add(
    "src_3_ocr_pages",
    f"""SELECT doc_id, {strip("string_agg(line, chr(10) || chr(10) ORDER BY line_no)")} AS raw_text, count(*) AS page_count,
    count(CASE WHEN {strip('line')} <> '' THEN 1 END) AS text_pages FROM plain_lines GROUP BY doc_id""",
)
CTES["half_lines"] = """SELECT doc_id, line_no, left(line, length(line) // 2) AS a,
  substring(line, length(line) // 2 + 1) AS b FROM plain_lines"""
add(
    "src_4_layout_entries",
    f"""SELECT doc_id, page_idx, count(*) AS entries, sum(length(text))::BIGINT AS chars, sum(r) AS right_edges, 595.0::DOUBLE AS width
    FROM (SELECT doc_id, line_no // 10 AS page_idx, text, r FROM (
      SELECT doc_id, line_no, a AS text, 250.0::DOUBLE AS r FROM half_lines WHERE a <> ''
      UNION ALL SELECT doc_id, line_no, b, 500.0 FROM half_lines WHERE b <> ''
      UNION ALL SELECT doc_id, line_no, a || ' ' || b, 500.0 FROM half_lines WHERE a <> '' AND b <> ''
      UNION ALL SELECT doc_id, line_no, concat_ws(' ', nullif(a, ''), nullif(b, '')), 500.0 FROM half_lines
        WHERE a <> '' OR b <> '')
      WHERE {fold(collapse('text'))} <> '') GROUP BY doc_id, page_idx""",
)
add(
    "src_5_layout_pages",
    f"""SELECT doc_id, line_no // 10 + 1 AS page_no, coalesce({strip("string_agg(nullif(t, ''), chr(10) || chr(10) ORDER BY line_no)")}, '') AS text
    FROM (SELECT doc_id, line_no, {strip(f"concat_ws(chr(10), nullif({strip('a')}, ''), nullif({strip('b')}, ''))")} AS t FROM half_lines)
    GROUP BY doc_id, line_no // 10""",
)
add(
    "src_6_evaluation_set",
    """SELECT 't' || item_id AS test_id, text AS question, CAST(item_id AS VARCHAR) AS expected_chunk_id,
    '' AS expected_document_id, 'say "a, b"' AS expected_chunk_title, 'one; two' AS expected_keywords FROM benchmark""",
)
add(
    "src_7_version_chunks",
    """SELECT version_id, row_number() OVER (PARTITION BY version_id ORDER BY chunk_index) AS place, chunk_index, chunk_title AS title
    FROM chunk_rows SEMI JOIN latest USING (version_id)""",
)
add(
    "src_8_ingest_context",
    """SELECT version_id, document_id, CASE WHEN e IS NULL THEN source_type END AS source_type,
    CASE WHEN e IS NULL THEN title END AS title, e AS error FROM (
    SELECT v.version_id, v.document_id, coalesce(d.source_type, 'upload') AS source_type, d.title,
      CASE WHEN d.document_id IS NULL THEN 'Document not found'
        WHEN coalesce(v.source_file_path, '') = '' THEN 'File path is missing' END AS e
    FROM versions v LEFT JOIN document_table d USING (document_id))""",
)
add(
    "snk_1_upsert",
    """SELECT id, label, document_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM (
    SELECT id, CASE WHEN id % 3 = 0 THEN label + 100 ELSE label END AS label, document_id, embedding FROM points
    UNION ALL SELECT id + 1000000000, label, document_id, embedding FROM points WHERE id % 5 = 0)""",
)
add("snk_2_vector_table", "SELECT id, chunk_kind, article_number FROM points")
add(
    "snk_3_delete_documents",
    """SELECT document_id, n AS before, CASE WHEN hit THEN 0 ELSE n END AS after, CASE WHEN hit THEN n ELSE 0 END AS deleted
    FROM (SELECT document_id, count(*) AS n, bool_or(label = 3) AS hit FROM points GROUP BY document_id)""",
)
add(
    "snk_4_delete_version",
    """SELECT document_id, version_id, previous_version_id AS metadata_version_id, version_no FROM versions
    WHERE version_id IS DISTINCT FROM '7' AND previous_version_id IS DISTINCT FROM '7'""",
)
add(
    "snk_5_chunk_rows",
    "SELECT version_id, count(*) AS n, max(chunk_index) AS last, count(DISTINCT chunk_index) < count(*) AS clash FROM chunk_rows GROUP BY version_id",
)
add(
    "snk_6_embedding_ids",
    "SELECT chunk_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN 'p-' || chunk_id END AS embedding_id FROM chunk_rows",
)
add(
    "snk_7_artifact_keys",
    """SELECT message_id, 'documents/text/' || strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y/%m') || '/' || session_id || '/' || role || '/'
    || message_id || '.txt' AS artifact_key, length(content) AS chars FROM messages""",
)
add(
    "snk_10_cascade_delete",
    """SELECT document_id, count(*) AS n, 'kept' AS what FROM versions SEMI JOIN document_table USING (document_id) GROUP BY document_id
    UNION ALL SELECT document_id, sum((source_file_path IS NOT NULL)::INT + (raw_text_path IS NOT NULL)::INT)::BIGINT, 'files'
    FROM versions ANTI JOIN document_table USING (document_id) GROUP BY document_id
    HAVING sum((source_file_path IS NOT NULL)::INT + (raw_text_path IS NOT NULL)::INT) > 0""",
)

# --- versions ----------------------------------------------------------------------------------

CTES["chunk_articles"] = """SELECT chunk_id, version_id, chunk_index, chunk_text, chunk_kind = 'amendment' AS is_amendment,
  CASE WHEN chunk_kind = 'amendment' THEN coalesce(nullif(target_article_number, ''), article_number)
    ELSE article_number END AS article FROM chunk_texts"""
CTES["linked"] = """SELECT c.chunk_id, c.version_id, v.previous_version_id, c.is_amendment, c.article, p.chunk_id AS previous_chunk_id,
  CASE WHEN v.previous_version_id IS NOT NULL AND c.article IS NOT NULL THEN
    CASE WHEN p.chunk_id IS NULL THEN 'new_article' WHEN c.is_amendment THEN 'amends_article' ELSE 'matched_article' END
    END AS relation_to_previous_version, left(p.chunk_text, 120) AS previous_chunk_title,
  CASE WHEN p.chunk_id IS NOT NULL THEN c.article END AS previous_article_number
  FROM chunk_articles c LEFT JOIN versions v ON v.version_id = c.version_id
  LEFT JOIN (SELECT * FROM chunk_articles WHERE article IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY version_id, article ORDER BY chunk_index DESC) = 1) p
    ON p.version_id = v.previous_version_id AND p.article = c.article"""
add(
    "ver_1_previous_version",
    """SELECT chunk_id, version_id, previous_version_id, relation_to_previous_version, previous_chunk_id,
    previous_chunk_title, previous_article_number FROM linked""",
)
add("ver_2_latest_versions", "SELECT document_id, version_id, version_no, source_file_path FROM latest")
add(
    "ver_3_next_versions",
    """SELECT b.document_id, b.version_id, coalesce(l.version_no, 0) + b.rn AS version_no,
    coalesce(b.before, l.version_id) AS previous_version_id FROM (
      SELECT d.source AS document_id, 'n' || d.doc_id AS version_id,
        row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS rn,
        lag('n' || d.doc_id) OVER (PARTITION BY d.source ORDER BY d.doc_id) AS before
      FROM labels JOIN documents d USING (doc_id)) b LEFT JOIN latest l USING (document_id)""",
)
add(
    "ver_4_checksums",
    """SELECT d.doc_id, sha256(d.text) AS source_checksum, sha256(c.text) AS checksum FROM dirty d JOIN cleaned c USING (doc_id)""",
)
CTES["plain_glue"] = CTES["glue"].replace("spaced_lines", "plain_spaced")
CTES["plain_spaced"] = f"SELECT doc_id, line_no, {strip(_spaces('line'))} AS line FROM plain_lines"
CTES["plain_glue"] = CTES.pop("plain_glue")
CTES["plain_glued"] = CTES["glued"].replace("FROM glue)", "FROM plain_glue)")
CTES["plain_cleaned"] = CTES["cleaned"].replace("glued", "plain_glued")
add(
    "ver_5_known_content",
    """SELECT doc_id AS document_id, first_id AS existing_document_id FROM (
    SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM plain_cleaned) WHERE doc_id <> first_id""",
)
_mime = (
    "CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/png' ELSE "
    "'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END"
)
_ok = ", ".join(f"'{t}'" for t in V.ALLOWED_TYPES)
add(
    "ver_6_upload_checks",
    f"""SELECT doc_id, CASE WHEN {_mime} NOT IN ({_ok}) THEN 'Unsupported file type' WHEN doc_id % 17 = 0
    THEN 'Filename is required' WHEN doc_id % 19 = 0 OR n_chars = 0 THEN 'File is empty' WHEN n_chars * 4000 > {V.MAX_UPLOAD_BYTES}
    THEN 'File size exceeds limit' END AS reject_reason FROM documents""",
)
add(
    "ver_7_field_updates",
    """SELECT v.version_id, CASE WHEN l.quality = 1 THEN 'completed' ELSE v.status END AS status,
    CASE WHEN l.toxic = 1 THEN 'clean.txt' ELSE v.cleaned_text_path END AS cleaned_text_path, v.raw_text_path
    FROM versions v LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = v.version_id""",
)
add(
    "ver_8_pending_jobs",
    "SELECT job_id, document_id, retry_count FROM job_rows WHERE status = 'pending' ORDER BY job_id LIMIT 10",
)
add(
    "ver_9_job_states",
    """SELECT job_id, CASE status WHEN 'pending' THEN 'running' WHEN 'running' THEN 'completed' ELSE 'failed' END AS status,
    CASE WHEN status = 'pending' THEN '2024-02-01' END AS started_at,
    CASE WHEN status IN ('running', 'completed') THEN '2024-02-01' END AS finished_at,
    CASE WHEN status = 'completed' THEN 'late' END AS error_message FROM job_rows""",
)
add(
    "ver_10_retries",
    """SELECT job_id, CASE WHEN retry_count >= 3 THEN 'failed' WHEN NOT failed THEN 'completed'
      WHEN retry_count + 1 < 3 THEN 'pending' ELSE 'failed' END AS next_status,
    CASE WHEN retry_count < 3 AND failed THEN retry_count + 1 ELSE retry_count END AS next_retry_count,
    CASE WHEN retry_count >= 3 THEN 'Exceeded max retries: 3' WHEN failed AND retry_count + 1 >= 3
      THEN 'Ingest failed: boom' END AS next_error,
    CASE WHEN status = 'running' THEN 'running' ELSE 'pending' END AS manual_status,
    CASE WHEN status = 'running' THEN retry_count ELSE 0 END AS manual_count FROM job_rows""",
)
add(
    "ver_11_document_list",
    """SELECT d.document_id, d.title, l.source_file_path AS file_path, coalesce(l.source_file_path, d.title) AS source_path,
    coalesce(v.n, 0) AS versions_count, coalesce(c.n, 0) AS chunks_count FROM document_table d
    LEFT JOIN latest l USING (document_id)
    LEFT JOIN (SELECT document_id, count(*) AS n FROM versions GROUP BY document_id) v USING (document_id)
    LEFT JOIN (SELECT document_id, count(*) AS n FROM chunk_rows JOIN versions USING (version_id) GROUP BY document_id) c
      USING (document_id)""",
)
add(
    "ver_12_version_page",
    """SELECT document_id, version_id, version_no FROM versions ORDER BY version_no DESC, document_id, version_id
    LIMIT 20 OFFSET 20""",
)
add("ver_13_page_count", "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM versions")

# --- retrieval -----------------------------------------------------------------------------------

CTES["chunk_vec"] = "SELECT * FROM chunk_texts"
add(
    "ret_2_embedding_text",
    """SELECT chunk_id, concat_ws(chr(10), 'Tiêu đề: ' || nullif(chunk_title, ''), 'Mục: ' || nullif(chunk_path, ''), chunk_text)
    AS text FROM chunk_vec""",
)
add(
    "ret_3_payload",
    """SELECT chunk_id, doc_id AS document_id, version_id, chunk_type, chunk_path AS section_path, chunk_title AS title,
    chunk_index, total_chunks, length(chunk_text) AS chars, chunk_kind FROM chunk_vec""",
)
add("ret_4_vector_topk", "SELECT query_id, query_index, id, score, rank FROM hits")
add("ret_5_filtered_topk", "SELECT query_id, query_index, id, score, rank FROM filtered_hits")
add(
    "ret_6_expanded_hits",
    """SELECT h.query_id, h.query_index, h.rank, h.id, p.document_id, p.chunk_kind, p.source
    FROM hits h JOIN points p ON p.id = h.id""",
)
add("ret_7_best_per_chunk", "SELECT query_id, id, score, matched_query_count FROM unique_best")
add("ret_8_first_per_chunk", "SELECT query_id, id, query_index, rank, score FROM unique_first")
add(
    "ret_9_result_keys",
    """SELECT id, CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) WHEN id % 3 = 0 THEN 'm' || id
      ELSE coalesce(document_id, 'None') || '::' || coalesce(lang, 'None') || '::' || coalesce(source, 'None') END AS key,
    CASE WHEN id % 3 = 0 THEN 'm' || id WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE '' END AS evaluation_key FROM points""",
)
add(
    "ret_10_candidates",
    """SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, query_index, rank, id) AS candidate_rank
    FROM (SELECT * FROM hits_20 QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, query_index, rank) = 1)
    QUALIFY candidate_rank <= 30""",
)
add(
    "ret_11_candidate_text",
    f"""SELECT id, left(concat_ws(chr(10), {strip("nullif(source, '')")}, {strip("nullif(lang, '')")}, article_number,
    {strip("nullif(text, '')")}), 8000) AS candidate FROM points""",
)
_words = lambda x: f"list_distinct(list_filter(string_split({keyword_text(x)}, ' '), lambda w: w <> ''))"
add(
    "ret_12_reranked",
    f"""SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, score DESC, query_index, rank, id) AS final_rank,
    round(s, 6) AS rerank_score, 'lexical_overlap' AS rerank_model FROM (
      SELECT u.*, coalesce(len(list_intersect(q, {_words('t')})) / nullif(len(q), 0), 0.0) AS s FROM (
        SELECT u.*, {_words("concat_ws(' ', p.lang, 'the la der de', p.chunk_kind)")} AS q,
          left(concat_ws(chr(10), {strip('p.source')}, {strip('p.lang')}, {strip("nullif(p.text, '')")}), 8000) AS t
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, query_index, rank, id) AS c FROM unique_best
          QUALIFY c <= 30) u JOIN points p ON p.id = u.id) u)
    QUALIFY final_rank <= 5""",
)
add(
    "ret_13_vector_fallback",
    "SELECT query_id, id, final_rank, score AS rerank_score, 'vector_score_fallback' AS rerank_model FROM ranked",
)
add(
    "ret_14_safe_float",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE 0.0 END AS number FROM events",
)
CTES["query_forms"] = f"""SELECT conv_id, turn, {strip('x')} AS x, i FROM (
  SELECT conv_id, turn, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (
    SELECT conv_id, turn, list_concat([text, lower(text), ' ', ' ' || text], string_split(text, '. ')) AS l FROM conversations))"""
add(
    "ret_15_expanded_queries",
    f"""SELECT conv_id, turn, count(*) AS n, string_agg(x, '|' ORDER BY i) AS queries FROM (
    SELECT * FROM query_forms WHERE x <> ''
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn, {collapse(fold('x'))} ORDER BY i) = 1) GROUP BY conv_id, turn""",
)
CTES["article_hits"] = "SELECT chunk_id AS query_id, chunk_id, 1 AS final_rank FROM chunk_articles_raw"
CTES["chunk_articles_raw"] = """SELECT chunk_id, CASE WHEN chunk_kind = 'amendment'
  THEN coalesce(nullif(target_article_number, ''), article_number) ELSE article_number END AS article_number FROM chunk_texts"""
CTES["article_hits"] = CTES.pop("article_hits")
CTES["relations"] = """SELECT h.query_id, h.final_rank AS source_rank, h.chunk_id AS source_chunk_id, o.chunk_id, 'amendment_to_original' AS relation
  FROM article_hits h JOIN linked l ON l.chunk_id = h.chunk_id JOIN linked o ON o.chunk_id = l.previous_chunk_id
  WHERE l.is_amendment
  UNION ALL SELECT h.query_id, h.final_rank, h.chunk_id, a.chunk_id, 'original_to_amendment'
  FROM article_hits h JOIN linked l ON l.chunk_id = h.chunk_id JOIN linked a ON a.previous_chunk_id = h.chunk_id
  WHERE NOT l.is_amendment AND a.is_amendment"""
add("ret_16_version_relations", "SELECT query_id, source_chunk_id, chunk_id, relation FROM relations")
CTES["appendix_refs"] = f"""SELECT chunk_id, doc_id, ref, row_number() OVER (PARTITION BY chunk_id ORDER BY first) - 1 AS position FROM (
  SELECT chunk_id, doc_id, ref, min(i) AS first FROM (
    SELECT chunk_id, doc_id, i, CASE u WHEN '1' THEN 'I' WHEN '2' THEN 'II' WHEN '3' THEN 'III' WHEN '4' THEN 'IV' WHEN '5' THEN 'V'
      WHEN '6' THEN 'VI' WHEN '7' THEN 'VII' WHEN '8' THEN 'VIII' WHEN '9' THEN 'IX' WHEN '10' THEN 'X' ELSE u END AS ref
    FROM (SELECT chunk_id, doc_id, upper(unnest(m)) AS u, generate_subscripts(m, 1) AS i FROM (
      SELECT chunk_id, doc_id, regexp_extract_all({collapse('chunk_text')}, {rx(L.APPENDIX_MENTION)}, 1) AS m FROM chunk_texts)))
  GROUP BY chunk_id, doc_id, ref)"""
CTES["appendix_chunks"] = """SELECT chunk_id, doc_id, chunk_path, CASE WHEN doc_id % 2 = 0 THEN appendix_number END AS number
  FROM chunk_rows WHERE chunk_kind = 'appendix'"""
CTES["wanted_refs"] = """SELECT DISTINCT doc_id, ref, CASE ref WHEN 'I' THEN '1' WHEN 'II' THEN '2' WHEN 'III' THEN '3' WHEN 'IV' THEN '4'
  WHEN 'V' THEN '5' WHEN 'VI' THEN '6' WHEN 'VII' THEN '7' WHEN 'VIII' THEN '8' WHEN 'IX' THEN '9' WHEN 'X' THEN '10' END AS digit
  FROM appendix_refs"""
CTES["by_number"] = "SELECT w.doc_id, w.ref, c.chunk_id FROM wanted_refs w JOIN appendix_chunks c ON c.doc_id = w.doc_id AND c.number = w.ref"
CTES["by_path"] = """SELECT DISTINCT w.doc_id, w.ref, c.chunk_id FROM wanted_refs w ANTI JOIN by_number n USING (doc_id, ref)
  JOIN appendix_chunks c ON c.doc_id = w.doc_id AND (c.chunk_path ILIKE '%Phụ lục ' || w.ref || '%'
    OR c.chunk_path ILIKE '%Phu luc ' || w.ref || '%' OR c.chunk_path ILIKE '%Phụ lục ' || w.digit || '%'
    OR c.chunk_path ILIKE '%Phu luc ' || w.digit || '%')"""
add(
    "ret_17_appendix_relations",
    """SELECT r.chunk_id AS source_chunk_id, f.chunk_id, r.position * 5 + f.rn AS position FROM appendix_refs r JOIN (
      SELECT *, row_number() OVER (PARTITION BY doc_id, ref ORDER BY chunk_id) AS rn
      FROM (SELECT * FROM by_number UNION ALL SELECT * FROM by_path) QUALIFY rn <= 5) f
    ON f.doc_id = r.doc_id AND f.ref = r.ref""",
)
add(
    "ret_18_appendix_references",
    f"""SELECT d.doc_id, coalesce(string_agg(r.ref, ',' ORDER BY r.first), '') AS refs FROM documents d LEFT JOIN (
      SELECT doc_id, ref, min(i) AS first FROM (
        SELECT doc_id, i, CASE u WHEN '1' THEN 'I' WHEN '2' THEN 'II' WHEN '3' THEN 'III' WHEN '4' THEN 'IV' WHEN '5' THEN 'V'
          WHEN '6' THEN 'VI' WHEN '7' THEN 'VII' WHEN '8' THEN 'VIII' WHEN '9' THEN 'IX' WHEN '10' THEN 'X' ELSE u END AS ref
        FROM (SELECT doc_id, upper(unnest(m)) AS u, generate_subscripts(m, 1) AS i FROM (
          SELECT doc_id, regexp_extract_all(text, {rx(L.APPENDIX_MENTION)}, 1) AS m FROM legal))) GROUP BY doc_id, ref) r USING (doc_id)
    GROUP BY d.doc_id""",
)
_roman = "(['I','II','III','IV','V','VI','VII','VIII','IX','X'])[doc_id % 12]"
_spell = lambda r: ", ".join(f"'%{s} ' || {r} || '%'" for s in ("Phụ lục", "PHỤ LỤC", "phụ lục", "Phu luc", "PHU LUC", "phu luc"))
add(
    "ret_19_numerals",
    f"""SELECT doc_id, roman, digit, CASE WHEN digit IS NULL THEN concat_ws('|', {_spell('roman')})
      ELSE concat_ws('|', {_spell('roman')}, {_spell('digit')}) END AS patterns FROM (
    SELECT doc_id, CASE WHEN doc_id % 12 BETWEEN 1 AND 10 THEN {_roman} ELSE CAST(doc_id % 12 AS VARCHAR) END AS roman,
      CASE WHEN doc_id % 12 BETWEEN 1 AND 10 THEN CAST(doc_id % 12 AS VARCHAR) END AS digit FROM documents)""",
)
add(
    "ret_20_appended",
    """SELECT query_id, chunk_id, relation, 'supporting' AS source_role FROM relations r ANTI JOIN article_hits h USING (query_id, chunk_id)
    QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY source_rank, relation, source_chunk_id) = 1""",
)
CTES["cited"] = """SELECT r.query_id, r.final_rank AS citation_id, r.id, coalesce(l.source_file_path, p.source) AS source,
  l.source_file_path AS file_path, d.mime_type, 'Chunk ' || r.id AS title, CASE WHEN r.id % 2 = 0 THEN p.lang END AS section_path,
  p.text FROM ranked r JOIN points p ON p.id = r.id LEFT JOIN latest l ON l.document_id = p.source
  LEFT JOIN document_table d ON d.document_id = p.source"""
add("ret_21_citations", "SELECT query_id, citation_id, id, source, file_path, mime_type, title, section_path FROM cited")
_pad = " " * 16
add(
    "ret_30_answer_batch",
    f"""SELECT query_id, coalesce(string_agg(CASE WHEN text <> '' THEN '[SOURCE ' || citation_id || ']' || chr(10) || '{_pad}Title: ' || title
      || chr(10) || '{_pad}Section: ' || coalesce(section_path, '') || chr(10) || chr(10) || '{_pad}' || text || chr(10)
      || '{_pad}[/SOURCE ' || citation_id || ']' END, chr(10) || chr(10) ORDER BY citation_id), '') AS context,
    count(*) AS sources FROM cited GROUP BY query_id""",
)
CTES["spoken"] = f"""SELECT session_id, message_id, role, {strip('content')} AS content, created_at FROM messages
  WHERE role IN ('user', 'assistant') AND {strip('content')} <> ''"""
add(
    "ret_22_recent_history",
    """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC) AS back,
    message_id, role, length(content) AS chars FROM spoken QUALIFY back <= 12""",
)
CTES["asked"] = f"""SELECT session_id, max(created_at) AS at, {strip('arg_max(content, created_at)')} AS question FROM messages
  WHERE role = 'user' GROUP BY session_id"""
CTES["pasts"] = """SELECT session_id, string_agg(CASE role WHEN 'user' THEN 'Nguoi dung' ELSE 'Tro ly' END || ': ' || content,
    chr(10) ORDER BY created_at) AS history FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.session_id ORDER BY s.created_at DESC) AS back
  FROM spoken s JOIN asked a ON a.session_id = s.session_id AND s.created_at < a.at QUALIFY back <= 8) GROUP BY session_id"""
add(
    "ret_23_retrieval_queries",
    f"""SELECT a.session_id, CASE WHEN coalesce(history, '') = '' THEN question ELSE {strip("'Lich su hoi thoai gan day:' || chr(10) || right(history, 1800) || chr(10) || chr(10) || 'Cau hoi hien tai:' || chr(10) || question")}
    END AS retrieval_query FROM asked a LEFT JOIN pasts USING (session_id)""",
)

# --- routing -----------------------------------------------------------------------------------------

_has = lambda terms: f"regexp_matches(f, '{'|'.join(terms)}')"
_word = lambda *p: rf"regexp_matches(f, '(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(p)})(?:[^\p{{L}}\p{{N}}_]|$)')"
CTES["intents"] = rf"""SELECT *, {_has(Q.LIST_TERMS)} AS list_i,
  NOT ({_has(Q.LEGAL_TERMS)} AND NOT (contact OR directory_t)) AND (people OR (contact AND {_word('cua')}) OR (directory_t AND contact)) AS directory_i,
  NOT ({_word(*Q.NOT_APPENDIX_TERMS)} AND NOT {_word(r'phu\s*luc')}) AND {_word(*Q.APPENDIX_TERMS)} AS appendix_i,
  {_has(Q.AMENDMENT_TERMS)} AS amendment_i,
  nullif(regexp_extract(f, '(?:^|[^\p{{L}}\p{{N}}_])dieu\s+(\d+[a-z]?)(?:[^\p{{L}}\p{{N}}_]|$)', 1), '') AS article,
  upper(nullif(regexp_extract(f, '(?:^|[^\p{{L}}\p{{N}}_])phu\s*luc\s+([ivxlcdm]+|\d+)(?:[^\p{{L}}\p{{N}}_]|$)', 1), '')) AS appendix
  FROM (SELECT *, {_has(Q.PEOPLE_TERMS)} AS people, {_has(Q.CONTACT_TERMS)} AS contact, {_has(Q.DIRECTORY_TERMS)} AS directory_t
    FROM (SELECT *, {collapse(fold('question'))} AS f FROM questions))"""
add(
    "ret_27_intents",
    """SELECT conv_id, turn, list_i AS list, directory_i AS directory, appendix_i AS appendix, amendment_i AS amendment,
    article AS article_number, appendix AS appendix_number FROM intents""",
)
CTES["rule_routes"] = """SELECT *, CASE WHEN article IS NOT NULL THEN 'exact_legal_lookup' WHEN directory_i THEN 'lecturer_lookup'
  WHEN appendix IS NOT NULL OR appendix_i THEN 'appendix_lookup' WHEN amendment_i THEN 'amendment_lookup' END AS rule,
  article AS rule_article FROM intents"""


def route_columns(strategy: str, article: str, appendix: str) -> str:
    k = f"CASE WHEN {strategy} = 'lecturer_lookup' AND list_i THEN 10 ELSE 3 END"
    return f"""{strategy} AS strategy, CASE {strategy} WHEN 'exact_legal_lookup' THEN 'article_number=' || {article}
      WHEN 'lecturer_lookup' THEN 'chunk_kind=Lecturer'
      WHEN 'appendix_lookup' THEN concat_ws('&', 'appendix_number=' || {appendix}, 'chunk_kind=appendix')
      WHEN 'amendment_lookup' THEN concat_ws('&', 'article_number=' || {article}, 'is_amendment=true') ELSE '' END AS filters,
    {k} AS top_k, CASE {strategy} WHEN 'exact_legal_lookup' THEN 9 WHEN 'lecturer_lookup' THEN greatest(({k}) * 3, 15)
      WHEN 'amendment_lookup' THEN 15 ELSE 12 END AS candidate_top_k,
    {strategy} IN ('amendment_lookup', 'broad_semantic_rag') AS use_expansion, {strategy} <> 'lecturer_lookup' AS use_related"""


add(
    "ret_25_rule_routes",
    f"""SELECT conv_id, turn, {route_columns('rule', "CASE WHEN rule = 'exact_legal_lookup' THEN article END", 'appendix')}
    FROM rule_routes WHERE rule IS NOT NULL""",
)
CTES["decisions"] = r"""SELECT *, CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.strategy') END AS d_strategy,
  json_extract_string(j, '$.article_number') AS d_article, json_extract_string(j, '$.appendix_number') AS d_appendix,
  json_extract_string(j, '$.confidence') AS d_confidence FROM (
  SELECT *, CASE WHEN json_valid(model_answer) THEN CASE WHEN json_type(model_answer) = 'OBJECT' THEN model_answer END
    ELSE CASE WHEN json_valid(inner_text) AND inner_text <> '' THEN inner_text END END AS j
  FROM (SELECT *, regexp_extract(model_answer, '(?s)(\{.*\})', 1) AS inner_text FROM rule_routes))"""
add(
    "ret_28_model_json",
    """SELECT conv_id, turn, d_strategy AS strategy, d_article AS article_number, d_appendix AS appendix_number,
    d_confidence AS confidence, CASE WHEN json_valid(model_answer) AND json_type(model_answer) = 'ARRAY'
      THEN array_to_string(CAST(CAST(model_answer AS JSON) AS VARCHAR[]), '|') ELSE 'q' END AS expansions FROM decisions""",
)
CTES["model_facts"] = """SELECT *, greatest(0.0, least(1.0, coalesce(TRY_CAST(d_confidence AS DOUBLE), 0.0))) AS conf,
  coalesce(article, CASE WHEN lower(trim(d_article)) NOT IN ('', 'null') THEN lower(trim(d_article)) END) AS m_article,
  coalesce(appendix, CASE WHEN lower(trim(d_appendix)) NOT IN ('', 'null') THEN upper(trim(d_appendix)) END) AS m_appendix
  FROM decisions"""
CTES["model_routes"] = """SELECT *, CASE WHEN d_strategy IS NULL OR conf < 0.55 THEN NULL
    WHEN d_strategy = 'exact_legal_lookup' THEN CASE WHEN m_article IS NOT NULL THEN 'exact_legal_lookup' END
    WHEN d_strategy = 'lecturer_lookup' THEN CASE WHEN NOT directory_i AND conf < 0.8 THEN 'broad_semantic_rag' ELSE d_strategy END
    WHEN d_strategy = 'appendix_lookup' THEN CASE WHEN m_appendix IS NULL AND NOT appendix_i THEN 'broad_semantic_rag' ELSE d_strategy END
    WHEN d_strategy = 'amendment_lookup' THEN CASE WHEN NOT amendment_i THEN 'broad_semantic_rag' ELSE d_strategy END
    WHEN d_strategy = 'low_context_or_invalid' THEN CASE WHEN conf >= 0.75 THEN d_strategy END
    WHEN d_strategy = 'broad_semantic_rag' THEN d_strategy END AS model FROM model_facts"""
add(
    "ret_26_model_routes",
    f"""SELECT conv_id, turn, {route_columns('model', 'm_article', 'm_appendix')}, round(conf, 6) AS confidence,
    CASE WHEN model = 'broad_semantic_rag' AND d_strategy <> 'broad_semantic_rag' THEN d_strategy END AS rejected
    FROM model_routes WHERE model IS NOT NULL""",
)
CTES["chosen_routes"] = """SELECT *, CASE WHEN len(list_filter(string_split(f, ' '), lambda w: w <> '')) <= 1 THEN 'low_context_or_invalid'
    WHEN by_rule THEN rule ELSE coalesce(model, rule, 'broad_semantic_rag') END AS chosen FROM (
  SELECT *, rule IS NOT NULL AND (model IS NULL OR model IN ('broad_semantic_rag', 'low_context_or_invalid')) AS by_rule FROM model_routes)"""
add(
    "ret_24_routes",
    f"""SELECT conv_id, turn, {route_columns('chosen',
    "CASE WHEN by_rule THEN CASE WHEN rule = 'exact_legal_lookup' THEN article END ELSE m_article END",
    "CASE WHEN by_rule THEN appendix ELSE m_appendix END")} FROM chosen_routes""",
)

# --- conversations -------------------------------------------------------------------------------------

CTES["live"] = "SELECT * FROM sessions WHERE deleted_at IS NULL"
add(
    "ana_1_session_search",
    """SELECT session_id, user_id, title, updated_at FROM live s WHERE (title ILIKE '%the%' OR EXISTS (
      SELECT 1 FROM messages m WHERE m.session_id = s.session_id AND m.content ILIKE '%the%'))
    AND updated_at >= 1704067200 AND EXISTS (SELECT 1 FROM messages m JOIN feedback f USING (message_id) WHERE m.session_id = s.session_id)
    ORDER BY updated_at DESC, session_id LIMIT 20 OFFSET 1""",
)
add(
    "ana_2_last_messages",
    f"""SELECT s.session_id, CASE WHEN c <> '' THEN left({collapse('c')}, 160) END AS last_message_preview, coalesce(n, 0) AS message_count
    FROM sessions s LEFT JOIN (SELECT session_id, arg_max(content, created_at) AS c, count(*) AS n FROM messages GROUP BY session_id) m
    USING (session_id)""",
)
add(
    "ana_3_messages_with_trace",
    """SELECT m.message_id, m.role, t.route, t.latency_ms, f.rating AS own_rating FROM messages m JOIN sessions s USING (session_id)
    LEFT JOIN traces t ON t.message_id = m.message_id
    LEFT JOIN feedback f ON f.message_id = m.message_id AND f.user_id = s.user_id AND f.again = 0 AND m.role = 'assistant'""",
)
add(
    "ana_4_chat_history",
    """SELECT session_id, message_id, role, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC) AS back
    FROM messages QUALIFY back <= 12""",
)
CTES["question_rows"] = """SELECT *, last_value(CASE WHEN role = 'user' THEN message_id END IGNORE NULLS) OVER (PARTITION BY session_id
  ORDER BY created_at, message_id ROWS UNBOUNDED PRECEDING) AS question_id FROM messages"""
CTES["answer_rows"] = """SELECT a.*, q.content AS question, q.created_at AS asked_at FROM question_rows a
  LEFT JOIN messages q ON q.message_id = a.question_id WHERE a.role = 'assistant'"""
add("ana_8_question_for_answer", "SELECT message_id, question_id, length(question) AS chars FROM answer_rows")
CTES["turns"] = "SELECT * FROM answer_rows WHERE question_id IS NOT NULL"
add(
    "ana_5_recorded_turns",
    f"""SELECT 'user' AS what, count(*) AS n FROM turns UNION ALL SELECT 'assistant', count(*) FROM turns
    UNION ALL SELECT 'latency', sum((created_at - asked_at) * 1000)::BIGINT FROM turns
    UNION ALL SELECT 'titled', count(*) FROM (
      SELECT coalesce(nullif(s.title, ''), left({collapse('t.q')}, 80)) AS title FROM sessions s LEFT JOIN (
        SELECT session_id, arg_min(question, asked_at) AS q FROM turns GROUP BY session_id) t USING (session_id))
      WHERE title IS NOT NULL""",
)
CTES["valid_feedback"] = """SELECT f.* FROM feedback f JOIN live s ON s.session_id = f.session_id AND s.user_id = f.user_id"""
add(
    "ana_6_feedback_upsert",
    """SELECT message_id, user_id, rating, reason FROM valid_feedback
    QUALIFY row_number() OVER (PARTITION BY message_id, user_id ORDER BY created_at DESC, feedback_id DESC) = 1""",
)
add(
    "ana_7_feedback_page",
    """SELECT feedback_id, rating, reason, created_at FROM feedback WHERE reason = 'outdated' AND admin_status = 'open'
    ORDER BY created_at DESC, feedback_id LIMIT 20 OFFSET 1""",
)
add(
    "ana_9_reviews",
    """SELECT feedback_id, CASE WHEN rating <= 2 THEN 'resolved' ELSE admin_status END AS admin_status,
    CASE WHEN rating = 1 THEN 'fixed' ELSE admin_note END AS admin_note, CASE WHEN rating <= 2 THEN 99 END AS reviewed_by,
    CASE WHEN rating <= 2 THEN 1710000000 END AS reviewed_at FROM feedback""",
)
add(
    "ana_10_totals",
    """SELECT (SELECT count(*) FROM sessions) AS total_sessions, (SELECT count(*) FROM messages) AS total_messages,
    (SELECT count(*) FROM feedback) AS total_feedbacks, round((SELECT avg(rating) FROM feedback), 6) AS average_rating,
    round((SELECT avg(latency_ms) FROM traces), 6) AS average_latency_ms""",
)
add(
    "ana_11_ratings",
    """SELECT r AS rating, coalesce(n, 0) AS n FROM (SELECT unnest([1, 2, 3, 4, 5]) AS r) LEFT JOIN
    (SELECT rating, count(*) AS n FROM feedback GROUP BY rating) f ON f.rating = r""",
)
add("ana_12_low_rating_reasons", "SELECT reason, count(*) AS n FROM feedback WHERE rating <= 3 AND reason IS NOT NULL GROUP BY reason")
add("ana_13_routes", "SELECT route, count(*) AS n FROM traces WHERE route IS NOT NULL GROUP BY route")
add(
    "ana_14_recent",
    """SELECT * FROM (SELECT 'feedback' AS what, feedback_id AS id, created_at FROM feedback ORDER BY created_at DESC, feedback_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'session', session_id, updated_at FROM live ORDER BY updated_at DESC, session_id LIMIT 5)""",
)
add(
    "ana_15_soft_delete",
    """SELECT session_id, CASE WHEN hit THEN 1710000000 ELSE updated_at END AS updated_at,
    CASE WHEN hit THEN 1710000000 ELSE deleted_at END AS deleted_at FROM (
    SELECT *, deleted_at IS NULL AND session_id IN (SELECT session_id FROM feedback WHERE rating = 1) AS hit FROM sessions)""",
)
_roles = ", ".join(f"'{r}'" for r in A.ROLES)
_reasons = ", ".join(f"'{r}'" for r in A.REASONS)
add(
    "ana_16_violations",
    f"""SELECT 'reason' AS check_name, CAST(feedback_id AS VARCHAR) AS row_key FROM feedback WHERE reason NOT IN ({_reasons})
    UNION ALL SELECT 'role', CAST(message_id AS VARCHAR) FROM messages WHERE role NOT IN ({_roles})
    UNION ALL SELECT 'unique_message_user', message_id || ':' || user_id FROM feedback GROUP BY message_id, user_id HAVING count(*) > 1""",
)

# --- evaluation ----------------------------------------------------------------------------------------

add(
    "eva_1_keywords",
    f"""SELECT conv_id, turn, coalesce(string_agg(k, '|' ORDER BY i), '') AS keywords FROM (
    SELECT conv_id, turn, k, min(i) AS i FROM (
      SELECT conv_id, turn, {keyword_text('x')} AS k, i FROM (
        SELECT conv_id, turn, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (
          SELECT conv_id, turn, string_split(replace(replace(text, '.', ';'), ',', ';'), ';') AS l FROM conversations)))
    GROUP BY conv_id, turn, k) WHERE k <> '' GROUP BY conv_id, turn""",
)
CTES["eval_set"] = """SELECT q.query_id, 't' || q.query_id AS test_id, q.n AS candidate_count, e.id AS expected,
  CASE WHEN q.query_id % 5 = 4 THEN [] ELSE list_concat([d.source, d.lang], string_split(replace(d.text, '.', ';'), ';'), ['no such term']) END AS words
  FROM (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id) q
  LEFT JOIN hits e ON e.query_id = q.query_id AND e.query_index = 0 AND e.rank = q.query_id % 7 + 1
  LEFT JOIN documents d ON d.doc_id = e.id"""
CTES["eval_hits"] = """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, query_index, rank, id) AS place
  FROM unique_best QUALIFY place <= 5"""
CTES["eval_contexts"] = f"""SELECT h.query_id, {keyword_text("string_agg(concat_ws(' ', coalesce(p.source, ''), coalesce(p.lang, ''), '', coalesce(p.article_number, ''), coalesce(p.text, '')), ' ' ORDER BY h.place)")} AS context
  FROM eval_hits h JOIN points p ON p.id = h.id WHERE h.place <= 3 GROUP BY h.query_id"""
CTES["eval_words"] = f"""SELECT query_id, list_distinct(list_filter(list_transform(string_split(replace(array_to_string(words, ';'), ',', ';'), ';'),
  lambda w: {keyword_text('w')}), lambda w: w <> '')) AS words FROM eval_set"""
CTES["eval_ranks"] = """SELECT s.*, h.place AS expected_rank FROM eval_set s LEFT JOIN eval_hits h ON h.query_id = s.query_id AND h.id = s.expected"""
CTES["eval_rows"] = """SELECT r.test_id, r.candidate_count, r.expected, r.expected_rank, r.query_id,
  (coalesce(r.expected_rank <= 1, false))::INT AS hit_at_1, (coalesce(r.expected_rank <= 3, false))::INT AS hit_at_3,
  (coalesce(r.expected_rank <= 5, false))::INT AS hit_at_5, coalesce(1.0 / r.expected_rank, 0.0) AS reciprocal_rank,
  CASE WHEN len(w.words) = 0 THEN CASE WHEN r.expected_rank <= 3 THEN 1.0 ELSE 0.0 END
    WHEN coalesce(c.context, '') = '' THEN 0.0
    ELSE len(list_filter(w.words, lambda k: contains(c.context, k))) / len(w.words) END AS context_recall
  FROM eval_ranks r JOIN eval_words w USING (query_id) LEFT JOIN eval_contexts c USING (query_id)"""
add("eva_2_expected_ranks", "SELECT test_id, coalesce(CAST(expected AS VARCHAR), '') AS expected_chunk_id, coalesce(expected_rank, 0) AS expected_rank FROM eval_rows")
add("eva_3_context", "SELECT 't' || query_id AS test_id, context FROM eval_contexts")
add("eva_4_context_recall", "SELECT test_id, round(context_recall, 6) AS context_recall FROM eval_rows")
add(
    "eva_5_question_metrics",
    """SELECT test_id, hit_at_1, hit_at_3, hit_at_5, round(reciprocal_rank, 6) AS reciprocal_rank, n AS retrieved_count, candidate_count,
    'vector_score_fallback' AS rerank_model FROM eval_rows JOIN (SELECT query_id, count(*) AS n FROM eval_hits GROUP BY query_id) USING (query_id)""",
)
add(
    "eva_6_summary",
    """SELECT count(*) AS total, round(avg(hit_at_1), 6) AS hit_at_1, round(avg(hit_at_3), 6) AS hit_at_3, round(avg(hit_at_5), 6) AS hit_at_5,
    round(avg(reciprocal_rank), 6) AS mrr, round(avg(context_recall), 6) AS context_recall FROM eval_rows""",
)
add(
    "eva_7_compact_lists",
    f"""SELECT 't' || h.query_id AS test_id, string_agg(CAST(h.id AS VARCHAR), '|' ORDER BY h.place) AS retrieved_chunk_ids,
    string_agg({strip("replace(coalesce(nullif(p.source, ''), nullif(p.lang, ''), ''), chr(10), ' ')")}, '|' ORDER BY h.place) AS retrieved_titles,
    string_agg(printf('%.6f', h.score), '|' ORDER BY h.place) AS retrieved_scores
    FROM eval_hits h JOIN points p ON p.id = h.id GROUP BY h.query_id""",
)
add(
    "snk_9_evaluation_files",
    f"""SELECT e.test_id, coalesce(CAST(e.expected AS VARCHAR), '') AS expected_chunk_id, e.hit_at_1::DOUBLE AS hit_at_1, e.hit_at_3::DOUBLE AS hit_at_3,
    e.hit_at_5::DOUBLE AS hit_at_5, round(e.reciprocal_rank, 6) AS reciprocal_rank, round(e.context_recall, 6) AS context_recall,
    l.retrieved_chunk_ids, l.n AS retrieved_count, (SELECT count(*) FROM eval_rows) AS questions
    FROM eval_rows e JOIN (SELECT query_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), '|' ORDER BY place) AS retrieved_chunk_ids
      FROM eval_hits GROUP BY query_id) l USING (query_id)""",
)
add(
    "snk_8_chunk_artifacts",
    """SELECT CAST(doc_id AS VARCHAR) AS document_id, count(*) AS chunks, sum(length(chunk_text))::BIGINT AS chars,
    max(total_chunks) AS total_chunks, count(*) AS blocks FROM chunk_texts GROUP BY doc_id""",
)

# --- streams -----------------------------------------------------------------------------------------------

CTES["job_changes"] = """SELECT document_id, job_id, event_id, status, retry_count, before_status AS previous_status FROM (
  SELECT *, lag(status) OVER w AS before_status, lag(retry_count) OVER w AS before_count FROM jobs
  WINDOW w AS (PARTITION BY document_id, job_id ORDER BY ts, event_id))
  WHERE before_status IS NULL OR before_status <> status OR before_count <> retry_count"""
add("stm_2_job_feed", "SELECT * FROM job_changes")
add("stm_2_job_stream", "SELECT * FROM job_changes")
add(
    "stm_2_document_snapshots",
    """SELECT document_id, count(*) AS jobs, count(CASE WHEN status NOT IN ('completed', 'failed') THEN 1 END) AS open_jobs,
    count(CASE WHEN status NOT IN ('completed', 'failed') THEN 1 END) = 0 AS terminal FROM (
    SELECT document_id, job_id, arg_max(status, (ts, event_id)) AS status FROM jobs GROUP BY document_id, job_id) GROUP BY document_id""",
)
add(
    "stm_2_snapshot_stream",
    """SELECT document_id, count(*) AS jobs, count(CASE WHEN status NOT IN ('completed', 'failed') THEN 1 END) AS open_jobs,
    count(CASE WHEN status NOT IN ('completed', 'failed') THEN 1 END) = 0 AS terminal FROM (
    SELECT document_id, job_id, arg_max(status, (ts, event_id)) AS status FROM jobs GROUP BY document_id, job_id) GROUP BY document_id""",
)
add(
    "stm_3_retry_stream",
    """SELECT job_id, CASE WHEN fails >= 3 THEN 'failed' WHEN done THEN 'completed' ELSE 'pending' END AS status, least(fails, 3) AS retry_count
    FROM (SELECT job_id, bool_or(status = 'completed') AS done,
      count(CASE WHEN status = 'failed' AND (first_done IS NULL OR (ts, event_id) < first_done) THEN 1 END) AS fails
      FROM (SELECT *, min(CASE WHEN status = 'completed' THEN (ts, event_id) END) OVER (PARTITION BY job_id) AS first_done FROM jobs)
    GROUP BY job_id)""",
)

# --- repairs and hooks with a direct twin --------------------------------------------------------------------

add("txt_11_ocr_repair", "SELECT doc_id, replace(text, '1. Sửa', '8. Sửa') AS text FROM legal")
add(
    "txt_13_tables",
    r"""SELECT page_id, 'before ' || chr(10) || '| ' || x[1] || ' | ' || CASE WHEN x[1] = x[2] THEN x[1] ELSE x[1] || ' - ' || x[2] END
      || ' | 0\| - 1\| |  |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)
      || array_to_string(list_filter(list_transform(x, lambda v, i: CASE WHEN i > 2 THEN '| ' || v || ' | ' || (i - 1) || '\| |  |  |' || chr(10) END),
        lambda v: v IS NOT NULL), '') || ' after' AS text
    FROM (SELECT page_id, regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a></li>', 1) AS x FROM pages)""",
)
_line_rule = lambda src, rule: f"""SELECT doc_id, array_to_string(list_transform(string_split({src}, chr(10)), lambda z: {rule}), chr(10)) AS text"""
_head = r"'(?i)^\s*((?:phụ\s*lục|phu\s*luc)\s+(?:[ivxlcdm]+|\d+))\s+(.+)$'"
_rest = f"trim(regexp_extract(trim(z), {_head}, 2))"
_tail = r"'(?s)^(.*?)(\s+\d+\.\s+.+)$'"
add(
    "txt_15_appendix_titles",
    _line_rule(
        r"regexp_replace(text, '(?m)^Điều (\d+)\. ', 'Phụ lục \1 ', 'g')",
        f"""CASE WHEN NOT regexp_matches(trim(z), {_head}) THEN z WHEN regexp_matches({_rest}, {_tail})
        THEN concat_ws(chr(10), regexp_extract(trim(z), {_head}, 1), nullif(trim(regexp_extract({_rest}, {_tail}, 1)), ''),
          trim(regexp_extract({_rest}, {_tail}, 2)))
        ELSE regexp_extract(trim(z), {_head}, 1) || chr(10) || {_rest} END""",
    )
    + " FROM legal",
)
_trail = r"'(?i)^(.{20,}?)\s+(\d+\.\s+[A-ZÀ-Ỵa-zà-ỵ][^\n]{1,80})$'"
add(
    "txt_16_trailing_headings",
    _line_rule(
        r"regexp_replace(text, '(?m)^theo Phụ lục 2 và (.*)\n(.{5,40}).*$', 'Bảng quy đổi theo \1 1. \2', 'g')",
        f"""CASE WHEN regexp_matches({fold(f'regexp_extract(trim(z), {_trail}, 1)')}, '{T.TRAILING_PHRASES}')
        THEN trim(regexp_extract(trim(z), {_trail}, 1)) || chr(10) || trim(regexp_extract(trim(z), {_trail}, 2)) ELSE z END""",
    )
    + " FROM legal",
)
add(
    "txt_17_inline_headings",
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\n(Điều \d+\.)', ' \1', 'g'),
    '([^\s])[ ]+((?:điều|dieu|Điều|ĐIỀU)\s+\d+[a-zA-Z]?\s*[.:]\s*)', '\1' || chr(10) || '\2', 'g') AS text FROM legal""",
)
_only = lambda cond, c: f"CASE WHEN {cond} THEN {c} END"
_amendment = "c.chunk_kind = 'amendment'"
add(
    "str_28_chunk_metadata",
    f"""SELECT c.chunk_id, d.source, 'upload' AS source_type, 'Document ' || c.doc_id AS doc_title, c.chunk_title,
    c.chunk_path AS section_path, c.chunk_index, c.total_chunks, c.doc_id::VARCHAR AS document_id,
    c.version_id AS document_version_id, v.version_no AS version_number, v.previous_version_id,
    CASE WHEN v.previous_version_id IS NOT NULL THEN v.version_no - 1 END AS previous_version_number,
    c.doc_id || '.txt' AS file_name, (len(string_split(l.text, chr(10))) + 9) // 10 AS page_count,
    c.doc_id % 2 = 0 AS ocr_enabled, c.doc_id % 10 = 0 AS force_ocr, CASE WHEN c.doc_id % 2 = 0 THEN '1' END AS ocr_pages,
    c.chunk_kind, 'active' AS status, v.version_no = v.latest AS is_current, c.part_title AS part, c.chapter_title AS chapter,
    c.section_title AS section, c.appendix_title, c.appendix_number, c.article_title,
    CASE WHEN {_amendment} THEN coalesce(nullif(c.target_article_number, ''), c.article_number) ELSE c.article_number END AS article_number,
    c.heading_level, c.heading_number, c.bboxes, c.page_sizes, c.page_indices, c.page_start, c.page_end,
    {_amendment} AS is_amendment, {_only(_amendment, 'c.action')} AS change_type,
    {_only(_amendment, 'c.article_number')} AS source_article_number,
    {_only(_amendment, 'c.target_article_number')} AS target_article_number,
    {_only(_amendment, 'c.target_clause_text')} AS target_clause_text, {_only(_amendment, 'c.target_point_text')} AS target_point_text,
    {_only(_amendment, 'c.order_number')} AS amendment_order_number, {_only(_amendment, 'c.title')} AS amendment_title,
    NULL::VARCHAR AS entity_type, NULL::VARCHAR AS lecturer_unit, NULL::INT AS lecturer_count, NULL::VARCHAR AS lecturer_names,
    NULL::VARCHAR AS lecturer_emails, NULL::VARCHAR AS lecturer_phones, NULL::VARCHAR AS lecturers
    FROM paged_chunks c JOIN documents d USING (doc_id) JOIN legal l USING (doc_id)
    JOIN (SELECT *, max(version_no) OVER (PARTITION BY document_id) AS latest FROM versions) v USING (version_id)""",
)
add("ret_1_embeddings", f"SELECT doc_id, 64 AS dim, CASE WHEN {keyword_text('text')} = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS norm FROM documents")
add(
    "ret_29_prompts",
    f"""SELECT a.session_id, concat_ws(chr(10) || chr(10), 'Ngày hiện tại: 07/05/2024' || chr(10) || 'Giờ hiện tại: 03:30:00' || chr(10)
      || 'Múi giờ: Asia/Ho_Chi_Minh' || chr(10) || 'Tháng hiện tại: 5' || chr(10) || 'Năm hiện tại: 2024',
      '[CHAT_HISTORY]' || chr(10) || nullif(history, '') || chr(10) || '[/CHAT_HISTORY]',
      '[CONTEXT]' || chr(10) || 'ctx' || chr(10) || '[/CONTEXT]', '[QUESTION]' || chr(10) || question || chr(10) || '[/QUESTION]') AS prompt
    FROM asked a LEFT JOIN pasts USING (session_id)""",
)
_now = """'Ngày hiện tại: 07/05/2024' || chr(10) || 'Giờ hiện tại: 03:30:00' || chr(10) || 'Múi giờ: Asia/Ho_Chi_Minh'
  || chr(10) || 'Tháng hiện tại: 5' || chr(10) || 'Năm hiện tại: 2024'"""
add(
    "ret_29_model_prompts",
    f"""SELECT conv_id, turn,
    concat_ws(chr(10) || chr(10), {_now}, 'expand', 'Câu hỏi cần mở rộng: ' || question) AS expand,
    concat_ws(chr(10) || chr(10), {_now}, 'route', 'Câu hỏi: ' || question) AS route,
    concat_ws(chr(10) || chr(10), {_now}, 'low', question) AS low
    FROM questions""",
)
_vowel = lambda v: f"(length(text) - length(replace(text, '{v}', '')))::DOUBLE"
_norm = "sqrt(" + " + ".join(f"{_vowel(v)} * {_vowel(v)}" for v in "aeiou") + ")"
add(
    "udf_1_embedder",
    f"""SELECT doc_id, 5 AS dim, round(CASE WHEN {_norm} = 0 THEN 0.0 ELSE CAST(CAST({_vowel('a')} / {_norm} AS FLOAT) AS DOUBLE) END, 4) AS first
    FROM documents""",
)
add("udf_2_pair_scorer", "SELECT doc_id, least(length(lang), length(text))::DOUBLE AS score FROM documents")
add("udf_3_generator", "SELECT doc_id, left(text, 40) AS answer FROM documents")
