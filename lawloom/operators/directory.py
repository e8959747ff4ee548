"""Staff directories: records between ===== rules, one chunk per unit of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawloom.functions.text import any_accent, collapse, fold, let, normalize_text, parser_line, strip, text_lines

ID = "doc_id"

# The directory title (folded), field labels, header words and texts of the output.
DIRECTORY_TITLE = "thong tin giang vien"
LABELS = {
    "unit": "đơn vị|don vi",
    "name": "tên|ten",
    "info": "thông tin|thong tin",
    "phone": "điện thoại|dien thoai",
    "email": "email",
}
HEADER_NAMES = ("ho va ten", "ten", "ho va ten, chuc danh, chuc vu")
UNKNOWN_UNIT = "Không rõ đơn vị"
EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
RULE = r"(?U)\s*={5,}\s*"


def may_be_directory(c: Column) -> Column:
    """A cheap necessary condition on the raw text: the words of the title, once tags between them are gone. Texts whose
    letters may come from character references, or that hide parts in comments or scripts, pass as well."""
    hidden = r"(?i)&(?:#\w+|[a-z][a-z0-9]*);|<(?:!--|script\b|style\b|template\b)"
    marked = F.contains(c, F.lit("&")) | F.contains(c, F.lit("<"))
    # the first letter once more as a plain class, which fails fast
    title = rf"(?=[gG\x80-\x{{10ffff}}])(?iuU){any_accent('giang')}\s*{any_accent('vien')}"
    bare = F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, "<[^>]*>", "")).otherwise(c)
    return (marked & c.rlike(hidden)) | bare.rlike(title)


def is_directory(c: Column) -> Column:
    """The first line with text is the directory title, and at least one record is valid."""
    first = strip(F.regexp_extract(c, r"(?U)\A\s*(\S[^\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*)", 1))
    titled = F.coalesce(fold(first) == DIRECTORY_TITLE, F.lit(False))
    return F.when(titled, F.size(directory_records(c)) > 0).otherwise(F.lit(False))


def _find(text: Column, label: str, start: Column) -> Column:
    """struct(start, end) of the first ``label:`` at or after ``start`` that follows white space; else NULL."""
    pattern = rf"(?iusU)\A(.*?)((?<!\S)(?:{label})\s*:)"
    seen = F.substring(text, F.greatest(start, F.lit(1)), F.lit(2**31 - 1))
    skipped = F.greatest(start - 1, F.lit(0))

    def at(rest: Column) -> Column:
        begin = skipped + F.length(F.regexp_extract(rest, pattern, 1))
        end = begin + F.length(F.regexp_extract(rest, pattern, 2))
        return F.when(rest.rlike(pattern), F.struct(begin.alias("begin"), end.alias("end")))

    return let(seen, at)


def _between(text: Column, label: Column, following: Column | None) -> Column:
    stop = F.length(text) if following is None else F.coalesce(following["begin"], F.length(text))
    value = F.substring(text, label["end"] + 1, F.greatest(stop - label["end"], F.lit(0)))
    return F.when(label.isNotNull(), F.nullif(collapse(value), F.lit("")))


def directory_record(block: Column) -> Column:
    """struct(unit, name, info, phone, email) from the labelled fields of one block, searched in that order."""
    after = lambda label: F.coalesce(label["end"], F.lit(0))

    def fields(t: Column, unit: Column, name: Column, info: Column, phone: Column, email: Column) -> Column:
        address = F.regexp_extract(F.coalesce(_between(t, email, None), F.lit("")), EMAIL, 0)
        return F.struct(
            _between(t, unit, name).alias("unit"),
            _between(t, name, info).alias("name"),
            _between(t, info, phone).alias("info"),
            _between(t, phone, email).alias("phone"),
            F.nullif(address, F.lit("")).alias("email"),
        )

    def locate(t: Column, names: list[str], found: list[Column]) -> Column:
        if not names:
            return fields(t, *found)
        start = after(found[-1]) if found else F.lit(0)
        return let(_find(t, LABELS[names[0]], start), lambda hit: locate(t, names[1:], [*found, hit]))

    return let(normalize_text(block), lambda t: locate(t, list(LABELS), []))


def is_valid_record(r: Column) -> Column:
    named = r["name"].isNotNull() & ~fold(r["name"]).isin(*HEADER_NAMES)
    other = F.coalesce(r["unit"], r["info"], r["phone"], r["email"])
    return F.coalesce(named & other.isNotNull(), F.lit(False))


def _record_blocks(c: Column) -> Column:
    """Texts between the rules of a directory, without its title."""
    return F.filter(
        F.transform(F.split(c, RULE), normalize_text),
        lambda b: (b != "") & (strip(fold(b)) != DIRECTORY_TITLE),
    )


def directory_records(c: Column) -> Column:
    """Valid records of a directory text, in order."""
    return F.filter(F.transform(_record_blocks(c), directory_record), is_valid_record)


def unit_content(unit: Column, records: Column) -> Column:
    """Numbered directory text of one unit."""
    blank = lambda c: F.nullif(c, F.lit(""))

    def entry(r: Column, i: Column) -> Column:
        return F.concat(
            F.concat_ws(
                "\n",
                F.concat((i + 1).cast("string"), F.lit(". Tên: "), r["name"]),
                F.concat(F.lit("   Thông tin: "), blank(r["info"])),
                F.concat(F.lit("   Điện thoại: "), blank(r["phone"])),
                F.concat(F.lit("   Email: "), blank(r["email"])),
            ),
            F.lit("\n"),
        )

    head = F.concat(
        F.lit("Đơn vị: "), unit, F.lit("\nSố lượng giảng viên/cán bộ: "), F.size(records).cast("string"), F.lit("\n\n")
    )
    return normalize_text(F.concat(head, F.array_join(F.transform(records, entry), "\n")))


def directory_chunks(docs: DataFrame, text: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One parsed chunk per (document, unit) of the directories, units in order of first appearance."""
    doc = F.struct(F.col(ID).alias("id"), *carry).alias("doc")
    text = F.col("text") if text is None else text
    found = let(text, lambda t: F.when(is_directory(t), directory_records(t)))
    records = docs.select(ID, doc, F.posexplode(found).alias("pos", "r"))
    unit = F.coalesce(F.col("r.unit"), F.lit(UNKNOWN_UNIT))
    value = lambda f: F.coalesce(F.col(f"r.{f}"), F.lit("")).alias(f)
    entry = F.struct("pos", *[value(f) for f in ("name", "unit", "info", "phone", "email")])
    grouped = (
        records.groupBy(ID, unit.alias("lecturer_unit"))
        .agg(F.first("doc").alias("doc"), F.array_sort(F.collect_list(entry)).alias("entries"))
        .withColumn("lecturers", F.transform("entries", lambda e: e.dropFields("pos")))
    )
    label = "Thông tin giảng viên"
    return grouped.select(
        ID,
        "doc",
        F.lit(0).cast("bigint").alias("block_id"),
        F.col("entries")[0]["pos"].cast("bigint").alias("item"),
        F.lit(0).cast("bigint").alias("sub"),
        F.lit("Lecturer").alias("chunk_kind"),
        collapse(F.concat(F.lit(f"{label}: "), "lecturer_unit")).alias("title"),
        unit_content(F.col("lecturer_unit"), F.col("lecturers")).alias("content"),
        F.concat(F.lit(f"{label} > "), "lecturer_unit").alias("section_path"),
        "lecturer_unit",
        "lecturers",
    )


def directory_lines(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc_id, block_id, item, line): the lines of all records of a unit; item is the place of its first record."""
    text = F.col("text") if text is None else text
    pair = lambda b: F.struct(directory_record(b).alias("r"), b.alias("block"))
    found = let(
        text,
        lambda t: F.when(is_directory(t), F.filter(F.transform(_record_blocks(t), pair), lambda x: is_valid_record(x["r"]))),
    )
    records = docs.select(ID, F.posexplode(found).alias("pos", "x")).withColumn(
        "unit", F.coalesce(F.col("x.r.unit"), F.lit(UNKNOWN_UNIT))
    )
    first = F.min("pos").over(Window.partitionBy(ID, "unit"))
    return records.withColumn("item", first.cast("bigint")).select(
        ID, F.lit(0).cast("bigint").alias("block_id"), "item", F.explode(F.transform(text_lines(F.col("x.block")), parser_line)).alias("line")
    )
