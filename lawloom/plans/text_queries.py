"""Registered queries: text normalisation and document structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawloom import session
from lawloom.functions import legal as L
from lawloom.functions import text as T
from lawloom.functions.tables import html_tables_to_markdown
from lawloom.operators import chunks as C
from lawloom.operators import directory as D
from lawloom.operators import layout as Y
from lawloom.operators import segmentation as S
from lawloom.operators import versions as V
from lawloom.plans import inputs as I
from lawloom.plans.ingest import laid_out_chunks
from lawloom.plans.registry import query


def _dirty(spark, sf_dir, column):
    return I.dirty(spark, sf_dir).select("doc_id", column(F.col("text")).alias("text"))


@query
def txt_1_newlines(spark, sf_dir):
    return _dirty(spark, sf_dir, T.normalize_newlines)


@query
def txt_2_spaces(spark, sf_dir):
    return _dirty(spark, sf_dir, T.normalize_spaces)


@query
def txt_3_stripped_lines(spark, sf_dir):
    lines = T.stripped_lines(T.normalize_newlines(F.col("text")))
    return I.dirty(spark, sf_dir).select("doc_id", F.posexplode(lines).alias("line_no", "line"))


@query
def txt_4_extra_blank_lines(spark, sf_dir):
    lines = T.drop_extra_blank_lines(T.stripped_lines(T.normalize_newlines(F.col("text"))))
    return I.dirty(spark, sf_dir).select("doc_id", F.array_join(lines, "\n").alias("text"))


@query
def txt_5_merged_lines(spark, sf_dir):
    lines = T.merge_broken_lines(T.stripped_lines(T.normalize_spaces(T.normalize_newlines(F.col("text")))))
    return I.dirty(spark, sf_dir).select("doc_id", F.array_join(lines, "\n").alias("text"))


@query
def txt_6_headings(spark, sf_dir):
    lines = I.plain_lines(I.legal(spark, sf_dir))
    return lines.select(
        "doc_id", "line_no", T.is_heading(F.col("line")).alias("heading"), T.is_bullet(F.col("line")).alias("bullet")
    )


@query
def txt_7_clean(spark, sf_dir):
    return _dirty(spark, sf_dir, T.clean)


@query
def txt_8_fold(spark, sf_dir):
    return I.legal(spark, sf_dir).select(
        "doc_id", T.fold(F.col("text")).alias("folded"), T.fold_collapsed(F.col("text")).alias("collapsed")
    )


@query
def txt_9_keyword_text(spark, sf_dir):
    return _dirty(spark, sf_dir, T.keyword_text)


@query
def txt_10_parser_text(spark, sf_dir):
    d = I.dirty(spark, sf_dir).withColumn("t", F.replace("text", F.lit("\u00a0"), F.lit(" ")))
    return d.select("doc_id", T.normalize_text(F.col("t")).alias("text"), T.collapse(F.col("t")).alias("line"))


@query
def txt_11_ocr_repair(spark, sf_dir):
    """Article keywords misread, and section signs before the amendment lines."""
    misread = F.regexp_replace(F.replace("text", F.lit("1. Sửa"), F.lit("§ Sửa")), "Điều (\\d)", "Điểu $1")
    return I.legal(spark, sf_dir).select("doc_id", T.repair_ocr(misread).alias("text"))


@query
def txt_12_footnotes(spark, sf_dir):
    noted = F.regexp_replace("text", "(?m)^2\\. ", "2.8 Đối với ")
    return I.legal(spark, sf_dir).select("doc_id", T.drop_footnote_markers(noted).alias("text"))


@query
def txt_13_tables(spark, sf_dir):
    """A table of each page's list items, the first cell spanning two rows."""
    items = F.regexp_extract_all("html", F.lit(r"<li><a[^>]*>([^<]*)</a></li>"), F.lit(1))
    rows = F.array_join(
        F.transform(
            items,
            lambda x, i: F.concat(
                F.lit("<tr>"), F.when(i == 0, F.concat(F.lit("<td rowspan=2>"), x, F.lit("</td>"))).otherwise(""),
                F.lit("<td>"), x, F.lit("</td><td colspan='2'>"), i.cast("string"), F.lit("|</td></tr>"),
            ),
        ),
        "",
    )
    text = F.concat(F.lit("before <table>"), rows, F.lit("</table> after"))
    return I.table(spark, sf_dir, "pages").select("page_id", html_tables_to_markdown(text).alias("text"))


@query
def txt_14_html_blocks(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select("page_id", T.html_blocks_to_text(F.col("html")).alias("text"))


@query
def txt_15_appendix_titles(spark, sf_dir):
    inline = F.regexp_replace("text", "(?m)^Điều (\\d+)\\. ", "Phụ lục $1 ")
    return I.legal(spark, sf_dir).select("doc_id", T.split_appendix_titles(inline).alias("text"))


@query
def txt_16_trailing_headings(spark, sf_dir):
    hidden = F.regexp_replace("text", "(?m)^theo Phụ lục 2 và (.*)\\n(.{5,40}).*$", "Bảng quy đổi theo $1 1. $2")
    return I.legal(spark, sf_dir).select("doc_id", T.split_trailing_headings(hidden).alias("text"))


@query
def txt_17_inline_headings(spark, sf_dir):
    joined = F.regexp_replace("text", "\\n(Điều \\d+\\.)", " $1")
    return I.legal(spark, sf_dir).select("doc_id", T.split_inline_headings(joined).alias("text"))


@query
def txt_18_parser_lines(spark, sf_dir):
    """Heading marks, page numbers and the fallback title."""
    d = I.dirty(spark, sf_dir).withColumn("t", T.normalize_text(F.replace("text", F.lit("\u00a0"), F.lit(" "))))
    kept = F.filter(F.transform(F.split("t", "\n"), T.parser_line), lambda x: x.isNotNull())
    return d.select("doc_id", T.fallback_title(F.col("t")).alias("title"), F.array_join(kept, "\n").alias("text"))


@query
def txt_19_previews(spark, sf_dir):
    c = I.table(spark, sf_dir, "conversations")
    text = F.col("text")
    return c.select(
        "conv_id", "turn", T.preview(text).alias("preview"), T.generated_title(text).alias("generated"),
        T.clean_title(text).alias("title"),
    )


# --- structure -------------------------------------------------------------------------


def legal_lines(spark, sf_dir):
    return S.document_lines(I.legal(spark, sf_dir), T.normalize_text(F.col("text")))


def legal_items(spark, sf_dir):
    return S.item_lines(S.block_lines(S.line_events(legal_lines(spark, sf_dir))))


def legal_parsed(spark, sf_dir):
    return S.parse_items(legal_items(spark, sf_dir))


def block_text_lines(spark, sf_dir, kind):
    """Lines of the blocks of one kind, keyed (doc_id, block_id)."""
    marked = S.block_lines(S.line_events(legal_lines(spark, sf_dir)))
    return marked.filter("content").filter(F.col("block.kind") == kind).select("doc_id", "block_id", "line_no", "line")


KEYS = ["doc_id", "block_id"]


@query
def str_1_section_headings(spark, sf_dir):
    return S.section_headings(I.legal(spark, sf_dir))


@query
def str_2_major_blocks(spark, sf_dir):
    return S.major_blocks(legal_lines(spark, sf_dir))


@query
def str_3_appendix_headings(spark, sf_dir):
    lines = legal_lines(spark, sf_dir).filter("line IS NOT NULL")
    return lines.select("doc_id", "line_no", L.is_real_appendix_heading(F.col("line")).alias("real"))


@query
def str_4_inner_headings(spark, sf_dir):
    lines = legal_lines(spark, sf_dir).filter("line IS NOT NULL")
    found = lines.withColumn("h", L.inner_heading(F.col("line"))).filter("h IS NOT NULL")
    return found.select("doc_id", "line_no", "h.kind", "h.number", "h.level")


@query
def str_5_false_headings(spark, sf_dir):
    lines = legal_lines(spark, sf_dir).filter("line IS NOT NULL").withColumn("h", L.inner_heading(F.col("line")))
    return lines.filter("h IS NOT NULL").select(
        "doc_id", "line_no", L.is_false_heading(F.col("line"), F.col("h.kind")).alias("rejected")
    )


@query
def str_6_heading_items(spark, sf_dir):
    return S.heading_items(legal_lines(spark, sf_dir), ("roman", "numbered", "clause"), ["doc_id"])


def _kind(spark, sf_dir, *branches):
    items = legal_items(spark, sf_dir).filter(F.col("branch").isin(*branches))
    return S.parse_items(items).drop("doc")


@query
def str_7_article_blocks(spark, sf_dir):
    return _kind(spark, sf_dir, "numbered", "free", "clause", "article").select(
        "doc_id", "block_id", "item", "chunk_kind", "title", "content", "article_number", "section_path"
    )


@query
def str_8_article_clauses(spark, sf_dir):
    """Every article split by its clauses where it has more than one."""
    items = S.heading_items(block_text_lines(spark, sf_dir, "article"), ("clause",), KEYS)
    n = items.groupBy(*KEYS).agg(F.count("*").alias("n")).filter("n > 1")
    return items.join(n, KEYS).drop("n")


@query
def str_9_appendix_blocks(spark, sf_dir):
    return _kind(spark, sf_dir, "appendix", "appendix_item").select(
        "doc_id", "block_id", "item", "sub", "title", "content", "appendix_title", "appendix_number",
        "heading_level", "heading_number",
    )


@query
def str_10_generic_blocks(spark, sf_dir):
    """Appendix blocks read as blocks of any other kind: split by four heading kinds."""
    return S.heading_items(
        block_text_lines(spark, sf_dir, "appendix"), ("roman", "numbered", "clause", "point"), KEYS
    )


@query
def str_11_numbered_amendments(spark, sf_dir):
    return S.numbered_amendment_items(block_text_lines(spark, sf_dir, "article"), KEYS)


@query
def str_12_free_form_amendments(spark, sf_dir):
    return S.free_form_items(block_text_lines(spark, sf_dir, "article"), KEYS)


@query
def str_13_amendment_targets(spark, sf_dir):
    return _kind(spark, sf_dir, "numbered", "free").select(
        "doc_id", "block_id", "item", "title", "action", "target_article_number", "target_clause_text",
        "target_point_text", "order_number",
    )


@query
def str_14_actions(spark, sf_dir):
    lines = legal_lines(spark, sf_dir)  # blank lines are not counted, a filter would read every line twice
    found = lines.groupBy(L.amendment_action(F.col("line")).alias("action")).agg(F.count("line").alias("n")).filter("n > 0")
    return found.select("action", L.action_label(F.col("action")).alias("label"), "n")


@query
def str_15_directory_units(spark, sf_dir):
    return D.directory_chunks(I.directory_documents(spark, sf_dir)).select(
        "doc_id", "title", "content", "section_path", "lecturer_unit", F.size("lecturers").alias("people")
    )


@query
def str_16_directory_fields(spark, sf_dir):
    d = I.directory_documents(spark, sf_dir)
    blocks = F.filter(F.split("text", D.RULE), lambda b: F.contains(b, F.lit(":")))
    rows = d.select("doc_id", F.explode(F.transform(blocks, D.directory_record)).alias("r"))
    return rows.select("doc_id", "r.*")


@query
def str_17_valid_records(spark, sf_dir):
    d = I.directory_documents(spark, sf_dir)
    return d.select("doc_id", F.explode(D.directory_records(F.col("text"))).alias("r")).select("doc_id", "r.*")


@query
def str_18_unit_content(spark, sf_dir):
    """The directory text of each document's units, with its length."""
    units = D.directory_chunks(I.directory_documents(spark, sf_dir))
    return units.select("doc_id", "lecturer_unit", F.length("content").alias("chars"), "content")


@query
def str_19_numbered_headings(spark, sf_dir):
    return _kind(spark, sf_dir, "section").select(
        "doc_id", "item", "title", "content", "heading_level", "heading_number"
    )


PARSED = (
    "doc_id", "chunk_index", "total_chunks", "chunk_kind", "title", "content", "part_title", "chapter_title",
    "section_title", "appendix_number", "article_number", "section_path", "action", "target_article_number",
)


@query
def str_20_parsed_documents(spark, sf_dir):
    return S.parse_documents(I.legal(spark, sf_dir)).select(*PARSED)


@query
def str_21_post_processed(spark, sf_dir):
    """Sizes of the cleaned chunks per kind before sections are merged."""
    p = legal_parsed(spark, sf_dir)
    return p.groupBy("chunk_kind").agg(
        F.count("*").alias("n"), F.sum(F.length("title")).alias("title_chars"), F.sum(F.length("content")).alias("chars"),
        F.min(F.length("content")).alias("shortest"),
    )


@query
def str_22_merged_sections(spark, sf_dir):
    merged = S.number_chunks(S.merge_small_sections(legal_parsed(spark, sf_dir)))
    return merged.filter("chunk_kind = 'section'").select(
        "doc_id", "chunk_index", "total_chunks", "title", "content", "section_path"
    )


def layout_input(spark, sf_dir):
    folded = F.filter(F.array(Y.layout_match_text(F.col("text"))), lambda x: x != "")  # computed once, unlike in a filter of rows
    return I.layout_rows(spark, sf_dir).select("*", F.explode(folded).alias("folded"))


@query
def str_23_line_layout(spark, sf_dir):
    lines = I.plain_lines(I.table(spark, sf_dir, "documents"))
    found = Y.lines_to_layout(lines, layout_input(spark, sf_dir), ["line_no"])
    return found.select("doc_id", "line_no", F.array_join("bbox", ",").alias("bbox"), "page_idx")


@query
def str_24_layout_payload(spark, sf_dir):
    """Boxes and pages of groups of seven lines."""
    lines = I.plain_lines(I.table(spark, sf_dir, "documents")).withColumn("unit", F.expr("line_no div 7"))
    payload = Y.layout_payload(Y.lines_to_layout(lines, layout_input(spark, sf_dir), ["unit"]), ["unit"])
    return payload.select(
        "doc_id", "unit", F.size("bboxes").alias("boxes"), F.array_join("page_indices", ",").alias("pages"),
        F.size("page_sizes").alias("sized_pages"),
    )


def chunk_documents(spark, sf_dir):
    """Legal texts as versions of their source, with the fields a chunk shows."""
    v = I.versions(spark, sf_dir).select("version_id", "version_no", "previous_version_id")
    d = I.legal(spark, sf_dir).withColumn("version_id", F.col("doc_id").cast("string"))
    return d.join(v, "version_id").select(
        "doc_id", "text", "source", F.concat(F.lit("Document "), "version_id").alias("title"),
        F.lit("upload").alias("source_type"), "version_id", "version_no", "previous_version_id",
    )


CARRY = ("source", "title", "source_type", "version_id", "version_no", "previous_version_id")


def chunk_table(spark, sf_dir):
    """Chunks of all legal texts. Parsing reads its texts three times, so their joins and lines are worked out before."""
    docs = session.materialize(chunk_documents(spark, sf_dir), "documents")
    return C.build_chunks(S.parse_documents(docs, carry=CARRY))


def laid_out_chunk_table(spark, sf_dir):
    """Chunks of legal texts with the pages and boxes of their lines: each text is laid out ten lines a page."""
    d = I.legal(spark, sf_dir)
    lines = I.plain_lines(d)
    whole = F.array(F.struct(F.lit("text").alias("type"), F.col("line").alias("content")))
    current = V.with_is_current(I.versions(spark, sf_dir)).select("version_id", "is_current")
    number = F.col("doc_id")
    docs = chunk_documents(spark, sf_dir).join(current, "version_id").withColumns(
        {
            "previous_version_number": F.when(F.col("previous_version_id").isNotNull(), F.col("version_no") - 1),
            "file_name": F.concat(number.cast("string"), F.lit(".txt")),
            "page_count": F.ceil(F.size(F.split("text", "\n")) / 10).cast("int"),
            "ocr_enabled": number % 2 == 0,
            "force_ocr": number % 10 == 0,
            "ocr_pages": F.when(number % 2 == 0, F.array(F.lit(1))),
        }
    )
    carry = (*CARRY, "previous_version_number", "file_name", "page_count", "ocr_enabled", "force_ocr", "ocr_pages", "is_current")
    return laid_out_chunks(docs, carry, I.layout_json(lines, whole))


@query
def str_25_chunk_rows(spark, sf_dir):
    return laid_out_chunk_table(spark, sf_dir).select(
        "chunk_id", "document_id", "version_id", "chunk_index", "total_chunks", "page_number", "page_end"
    )


@query
def str_26_chunk_paths(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("document_id", "chunk_index", "chunk_type", "title", "section_path")


@query
def str_27_chunk_texts(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("document_id", "chunk_index", "chunk_text")


@query
def str_28_chunk_metadata(spark, sf_dir):
    """All fields of the metadata; lists and maps as text."""
    m = F.col("metadata")
    listed = lambda c: F.array_join(c, ",")
    box = lambda b: F.concat(F.array_join(b["bbox"], ","), F.lit("@"), b["page_idx"])
    size = lambda e: F.concat_ws("x", F.concat(e["key"], F.lit(":"), e["value"]["width"]), e["value"]["height"])
    texts = {
        "ocr_pages": listed(m["ocr_pages"]),
        "bboxes": F.array_join(F.transform(m["bboxes"], box), "|"),
        "page_sizes": F.array_join(F.transform(F.map_entries(m["page_sizes"]), size), ","),
        "page_indices": listed(m["page_indices"]),
        "lecturers": F.to_json(m["lecturers"]),
        **{c: listed(m[c]) for c in ("lecturer_names", "lecturer_emails", "lecturer_phones")},
    }
    chunks = laid_out_chunk_table(spark, sf_dir)
    fields = chunks.schema["metadata"].dataType.names
    return chunks.select("chunk_id", *[texts.get(c, m[c]).alias(c) for c in fields])
