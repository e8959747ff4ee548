"""Parsed chunks to chunk rows: type, title, path, labelled text, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions.legal import action_label
from lawloom.functions.text import strip

ID = "doc_id"

# Labels of the chunk text header.
AMENDMENT_BODY = {
    "repeal": "Nội dung bị bãi bỏ:",
    "supplement": "Nội dung được bổ sung:",
    "replace": "Nội dung thay thế:",
    "modify": "Nội dung sau sửa đổi:",
}


def _shown(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), _shown(value.cast("string")))


def chunk_type() -> Column:
    kind = F.col("chunk_kind")
    return (
        F.when(kind == "Lecturer", "Lecturer")
        .when(kind == "amendment", "regulation_amendment")
        .when(kind == "article", "regulation")
        .when(kind == "section", "document_section")
        .when(kind == "table", "table")
        .otherwise("document_chunk")
    )


def chunk_title() -> Column:
    label, target, clause = action_label(F.col("action")), F.col("target_article_number"), F.col("target_clause_text")
    amended = (F.col("chunk_kind") == "amendment") & F.coalesce(target != "", F.lit(False))
    return (
        F.when(amended & F.coalesce(clause != "", F.lit(False)),
               F.concat(label, F.lit(" khoản "), clause, F.lit(", Điều "), target))
        .when(amended, F.concat(label, F.lit(" Điều "), target))
        .otherwise(F.col("title"))
    )


def breadcrumb(parts: Column) -> Column:
    """Non-empty stripped parts without consecutive repeats, joined by ' > '."""
    kept = F.filter(F.transform(F.array_compact(parts), strip), lambda x: x != "")
    marked = F.zip_with(
        kept,
        F.slice(F.concat(F.array(F.lit("")), kept), F.lit(1), F.size(kept)),
        lambda x, before: F.when(x != before, x),
    )
    return F.array_join(F.array_compact(marked), " > ")


def chunk_path() -> Column:
    amendment = F.concat_ws(
        " > ",
        F.lit("Văn bản sửa đổi/bổ sung"),
        _labelled("Điều chứa nội dung sửa đổi ", F.col("article_number")),
        _labelled("Điều được tác động ", F.col("target_article_number")),
        _labelled("Khoản ", F.col("target_clause_text")),
        action_label(F.col("action")),
    )
    body = F.coalesce(_shown(F.col("section_path")), F.col("title"))
    parts = F.array("part_title", "chapter_title", "section_title", body)
    return F.when(F.col("chunk_kind") == "amendment", amendment).otherwise(breadcrumb(parts))


def chunk_text(doc_title: Column) -> Column:
    """The context header of each chunk kind and its content; empty parts vanish."""
    kind, content = F.col("chunk_kind"), F.col("content")
    head = F.concat(F.lit("Tài liệu: "), doc_title)
    body_label = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in AMENDMENT_BODY.items() for x in kv]), F.col("action")),
        F.lit("Nội dung:"),
    )
    names = F.filter(F.transform("lecturers", lambda r: r["name"]), lambda n: n != "")
    directory = F.concat_ws(
        "\n",
        head,
        F.lit("Loại chunk: Lecturer"),
        _labelled("Đơn vị: ", F.col("lecturer_unit")),
        F.when(F.size("lecturers") > 0, _labelled("Số lượng giảng viên/cán bộ: ", F.size("lecturers"))),
        F.when(F.size(names) > 0, F.concat(F.lit("Danh sách tên: "), F.array_join(names, ", "))),
        F.lit("Nội dung:"),
        content,
    )
    amendment = F.concat_ws(
        "\n",
        head,
        F.lit("Loại chunk: Nội dung sửa đổi/bổ sung/bãi bỏ"),
        F.concat(F.lit("Loại thay đổi: "), action_label(F.col("action"))),
        _labelled("Điều chứa nội dung sửa đổi: ", F.col("article_title")),
        _labelled("Điều được tác động: Điều ", F.col("target_article_number")),
        _labelled("Khoản được tác động: ", F.col("target_clause_text")),
        F.concat(F.lit("Tiêu đề nội dung sửa đổi: "), F.col("title")),
        body_label,
        content,
    )
    article = F.concat_ws(
        "\n",
        head,
        F.lit("Loại chunk: Điều trong văn bản"),
        _labelled("Chương: ", F.col("chapter_title")),
        _labelled("Mục: ", F.col("section_title")),
        _labelled("Điều: ", F.col("article_title")),
        F.lit("Nội dung:"),
        content,
    )
    section = F.concat_ws(
        "\n",
        head,
        F.lit("Loại chunk: Mục nội dung"),
        _labelled("Số mục: ", F.col("heading_number")),
        F.when(F.col("heading_level") != 0, _labelled("Cấp mục: ", F.col("heading_level"))),
        _labelled("Mục cha: ", F.col("section_title")),
        F.concat(F.lit("Tiêu đề mục: "), F.col("title")),
        F.lit("Nội dung:"),
        content,
    )
    other = F.concat_ws(
        "\n",
        head,
        F.concat(F.lit("Loại chunk: "), kind),
        F.concat(F.lit("Tiêu đề: "), F.col("title")),
        F.lit("Nội dung:"),
        content,
    )
    return (
        F.when(kind == "Lecturer", directory)
        .when(kind == "amendment", amendment)
        .when(kind == "article", article)
        .when(kind == "section", section)
        .otherwise(other)
    )


def chunk_metadata(title: Column, path: Column, has: set[str]) -> Column:
    """The fixed metadata struct; document fields that were not carried are NULL."""

    def doc(name: str, kind: str) -> Column:
        value = F.col(f"doc.{name}") if name in has else F.lit(None)
        return value.cast(kind)

    amendment = F.col("chunk_kind") == "amendment"
    directory = F.col("chunk_kind") == "Lecturer"
    people = lambda f: F.when(
        directory, F.filter(F.transform("lecturers", lambda r: r[f]), lambda x: x != "")
    )
    fields = {
        "source": doc("source", "string"),
        "source_type": doc("source_type", "string"),
        "doc_title": doc("title", "string"),
        "chunk_title": title,
        "section_path": path,
        "chunk_index": F.col("chunk_index").cast("int"),
        "total_chunks": F.col("total_chunks").cast("int"),
        "document_id": F.col("doc.id").cast("string"),
        "document_version_id": doc("version_id", "string"),
        "version_number": doc("version_no", "int"),
        "previous_version_id": doc("previous_version_id", "string"),
        "previous_version_number": doc("previous_version_number", "int"),
        "file_name": doc("file_name", "string"),
        "page_count": doc("page_count", "int"),
        "ocr_enabled": doc("ocr_enabled", "boolean"),
        "force_ocr": doc("force_ocr", "boolean"),
        "ocr_pages": doc("ocr_pages", "array<int>"),
        "chunk_kind": F.col("chunk_kind"),
        "status": F.lit("active"),
        "is_current": F.coalesce(doc("is_current", "boolean"), F.lit(True)),
        "part": F.col("part_title"),
        "chapter": F.col("chapter_title"),
        "section": F.col("section_title"),
        "appendix_title": F.col("appendix_title"),
        "appendix_number": F.col("appendix_number"),
        "article_title": F.col("article_title"),
        "article_number": F.when(
            amendment, F.coalesce(_shown(F.col("target_article_number")), F.col("article_number"))
        ).otherwise(F.col("article_number")),
        "heading_level": F.col("heading_level"),
        "heading_number": F.col("heading_number"),
        "bboxes": F.col("bboxes"),
        "page_sizes": F.col("page_sizes"),
        "page_indices": F.coalesce("page_indices", F.array().cast("array<int>")),
        "page_start": F.col("page_start"),
        "page_end": F.col("page_end"),
        "is_amendment": amendment,
        "change_type": F.when(amendment, F.col("action")),
        "source_article_number": F.when(amendment, F.col("article_number")),
        "target_article_number": F.when(amendment, F.col("target_article_number")),
        "target_clause_text": F.when(amendment, F.col("target_clause_text")),
        "target_point_text": F.when(amendment, F.col("target_point_text")),
        "amendment_order_number": F.when(amendment, F.col("order_number")),
        "amendment_title": F.when(amendment, F.col("title")),
        "entity_type": F.when(directory, F.lit("Lecturer")),
        "lecturer_unit": F.when(directory, F.col("lecturer_unit")),
        "lecturer_count": F.when(directory, F.size("lecturers")),
        "lecturer_names": people("name"),
        "lecturer_emails": people("email"),
        "lecturer_phones": people("phone"),
        "lecturers": F.when(directory, F.col("lecturers")),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


_LAYOUT = {
    "bboxes": "array<struct<bbox:array<double>,page_idx:int>>",
    "page_sizes": "map<int,struct<width:double,height:double>>",
    "page_indices": "array<int>",
}


def build_chunks(parsed: DataFrame) -> DataFrame:
    """Chunk rows with a deterministic id; ``doc`` carries the document's own fields."""
    has = set(parsed.schema["doc"].dataType.names)
    rows = parsed
    for name, kind in _LAYOUT.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    version = F.col("doc.version_id").cast("string") if "version_id" in has else F.lit(None).cast("string")
    doc_title = F.col("doc.title") if "title" in has else F.col("doc.id").cast("string")
    title, path = chunk_title(), chunk_path()
    pages = F.col("page_indices")
    rows = (
        rows.withColumn("page_start", F.array_min(pages) + 1)
        .withColumn("page_end", F.array_max(pages) + 1)
        .withColumn("chunk_title", title)
        .withColumn("chunk_path", path)
    )
    key = F.concat_ws("|", F.col("doc.id").cast("string"), F.coalesce(version, F.lit("")), F.col("chunk_index"))
    return rows.select(
        F.sha2(key, 256).alias("chunk_id"),
        F.col(ID).alias("document_id"),
        version.alias("version_id"),
        "chunk_index",
        "total_chunks",
        chunk_type().alias("chunk_type"),
        F.col("chunk_title").alias("title"),
        F.col("chunk_path").alias("section_path"),
        chunk_text(doc_title).alias("chunk_text"),
        F.col("content").alias("cleaned_text"),
        F.lit(None).cast("int").alias("token_count"),
        F.col("page_start").alias("page_number"),
        F.col("page_end"),
        F.lit(None).cast("string").alias("embedding_id"),
        chunk_metadata(F.col("chunk_title"), F.col("chunk_path"), has).alias("metadata"),
    )
