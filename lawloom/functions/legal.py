"""Recognisers for regulation text: headings, amendments, appendix references (all Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lawloom.functions.text import WORD_END, collapse, fold, let, may_fold_to, strip

MAX_CHUNK_CHARS = 4500
MIN_SECTION_CHARS = 900

# Heading keywords, accented and plain.
_NUM = r"([ivxlcdm]+|\d+)"
PART = rf"(?iu)^\s*(?:phần|phan)\s+{_NUM}{WORD_END}"
CHAPTER = rf"(?iu)^\s*(?:chương|chuong)\s+{_NUM}{WORD_END}"
SECTION = rf"(?iu)^\s*(?:mục|muc)\s+{_NUM}{WORD_END}"
APPENDIX = rf"(?iu)^\s*(?:phụ\s*lục|phu\s*luc)(?:\s+{_NUM})?\s*$"
ARTICLE = r"(?iu)^\s*(?:điều|dieu)\s+(\d+[a-zA-Z]?)\s*[.:]?\s*(.*)$"
ROMAN = r"^\s*([IVXLCDM]+)\.\s+(.+)$"
POINT = r"(?iu)^\s*([a-zđ])\)\s+(.+)$"
BULLET = r"^\s*[-+•]\s+(.+)$"
NUMBERED = r"^\s*((?:\d+\.)+\d*|\d+)\.?\s+(.+)$"
AMENDMENT_ITEM = r"^\s*(\d+)\.\s+(.+)$"

# Folded amendment verbs and the words around them.
_VERB = "sua doi|bo sung|thay the|bai bo"
_VERB_ACCENTED = "sửa đổi|bổ sung|thay thế|bãi bỏ"
AMENDMENT_TITLE = rf"^\s*\d+\.\s+.*(?:{_VERB}).*?(?:dieu|khoan)\s+\d+"
FREE_FORM = rf"^\s*(?:{_VERB})\s+(.+)$"
APPENDIX_REFERENCE_WORDS = "theo|xem|tai|quy dinh tai|duoc quy dinh tai|ban hanh kem"
ADDRESS_WORDS = "duong|phuong|quan|huyen|tinh|thanh pho|nguyen|tran|le "
THOUSANDS = r"^(?:1\.000|2\.000|3\.000)"

SECTION_KEYWORDS = (
    ("chapter", r"(?iu)^(chương\s+([ivxlcdm0-9]+)\s*[:.\-]?\s*.*)$"),
    ("section", r"(?iu)^(mục\s+(\d+)\s*[:.\-]?\s*.*)$"),
    ("article", r"(?iu)^(điều\s+(\d+)\s*[:.\-]?\s*.*)$"),
)


def section_heading(line: Column) -> Column:
    """struct(level, number) of a chapter, section or article heading, else NULL."""
    out = F.lit(None).cast("struct<level:string,number:string>")
    for level, pattern in reversed(SECTION_KEYWORDS):
        hit = F.struct(F.lit(level).alias("level"), F.regexp_extract(line, pattern, 2).alias("number"))
        out = F.when(line.rlike(pattern), hit).otherwise(out)
    return out


# How a line that bears on blocks starts: part, chapter, section, article, appendix or a number.
MAY_BE_EVENT = r"(?iu)\A[pcmdđ\d\s\p{Mn}]"


def is_real_appendix_heading(line: Column) -> Column:
    refers = rf"(?:^|[^a-z0-9_])(?:{APPENDIX_REFERENCE_WORDS})(?:[^a-z0-9_]|$)"
    real = lambda text: (
        (F.length(text) <= 50) & ~text.rlike(r"[()]") & ~fold(text).rlike(refers) & text.rlike(APPENDIX)
    )
    return line.rlike(APPENDIX) & let(collapse(line), real)


def is_amendment_title(folded: Column) -> Column:
    return folded.rlike(AMENDMENT_TITLE)


def is_free_form_amendment(folded: Column) -> Column:
    return folded.rlike(FREE_FORM)


# What a line has whose folded form is an amendment: marks vanish, so they may stand between its letters.
_MAY_BE_TITLE = rf"\A[\s\p{{Mn}}]*\d[\d\p{{Mn}}]*\..*{may_fold_to(_VERB)}"
_MAY_BE_FREE_FORM = rf"\A[\s\p{{Mn}}]*{may_fold_to(_VERB)}"


def opens_amendment_title(line: Column) -> Column:
    """`is_amendment_title` of the folded line; only lines with a number and a verb are folded."""
    return line.rlike(_MAY_BE_TITLE) & is_amendment_title(fold(line))


def opens_free_form_amendment(line: Column) -> Column:
    """`is_free_form_amendment` of the folded line; only lines that start with a verb are folded."""
    return line.rlike(_MAY_BE_FREE_FORM) & is_free_form_amendment(fold(line))


def _looks_real(line: Column) -> Column:
    return (F.length(line) <= 180) & ~line.rlike(THOUSANDS)


INNER = "struct<kind:string,number:string,level:int>"


def _inner(kind: Column, number: Column, level: Column) -> Column:
    return F.struct(kind.alias("kind"), number.alias("number"), level.cast("int").alias("level"))


# How a line with an inner heading starts.
_MAY_BE_INNER = r"\A(?:[\sIVXLCDM\d+•-]|(?iu:[a-zđ]\)))"


def inner_heading(line: Column) -> Column:
    """Roman, point, bullet, numbered or clause heading, in that priority; NULL for plain text."""
    return F.when(F.left(line, F.lit(2)).rlike(_MAY_BE_INNER), _inner_heading(line))


def _inner_heading(line: Column) -> Column:
    raw = F.regexp_extract(line, NUMBERED, 1)
    number = F.regexp_replace(raw, r"\.+$", "")
    dotted = F.contains(number, F.lit("."))
    return (
        F.when(line.rlike(ROMAN) & _looks_real(line), _inner(F.lit("roman"), F.regexp_extract(line, ROMAN, 1), F.lit(1)))
        .when(line.rlike(POINT), _inner(F.lit("point"), F.regexp_extract(line, POINT, 1), F.lit(3)))
        .when(line.rlike(BULLET), _inner(F.lit("bullet"), F.lit(None).cast("string"), F.lit(4)))
        .when(
            (raw != "") & _looks_real(line),
            _inner(
                F.when(dotted, F.lit("numbered")).otherwise(F.lit("clause")),
                number,
                F.when(dotted, F.size(F.split(number, r"\.")) + 1).otherwise(F.lit(2)),
            ),
        )
    )


def is_false_heading(line: Column, kind: Column) -> Column:
    bare = line.rlike(r"^\d+\s") & ~line.rlike(r"^\s*\d+\.")
    number = F.regexp_extract(line, r"^(\d+)", 1).try_cast("decimal(38,0)")
    address = fold(line).rlike(ADDRESS_WORDS)
    numbered = kind.isin("clause", "numbered") & (
        line.rlike(r"^\d+\.\s*$") | (bare & ((number > 20) | number.isNull() | address))
    )
    return (F.length(line) > 180) | line.rlike(THOUSANDS) | numbered


def accepted_heading(line: Column, *allowed: str) -> Column:
    """The inner heading of a line when its kind is allowed and it is not a false positive."""
    accepted = let(
        _inner_heading(line),
        lambda h: F.when(h["kind"].isin(*allowed) & ~is_false_heading(line, h["kind"]), h),
    )
    return F.when(F.left(line, F.lit(2)).rlike(_MAY_BE_INNER), accepted)


def amendment_action(text: Column) -> Column:
    folded = fold(text)
    return (
        F.when(F.contains(folded, F.lit("sua doi")), F.lit("modify"))
        .when(F.contains(folded, F.lit("bo sung")), F.lit("supplement"))
        .when(F.contains(folded, F.lit("thay the")), F.lit("replace"))
        .when(F.contains(folded, F.lit("bai bo")), F.lit("repeal"))
        .otherwise(F.lit("unknown"))
    )


# Labels of the amendment kinds.
ACTION_LABELS = {
    "modify": "Sửa đổi",
    "supplement": "Bổ sung",
    "replace": "Thay thế",
    "repeal": "Bãi bỏ",
    "rename": "Sửa đổi tên gọi",
    "unknown": "Không xác định",
}


def action_label(action: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in ACTION_LABELS.items() for x in kv])
    return F.coalesce(
        F.try_element_at(labels, F.coalesce(action, F.lit("unknown"))), action, F.lit(ACTION_LABELS["unknown"])
    )


# Shapes of an amendment title, each accented and folded.
_POINT_CLAUSE = (
    rf"(?iu)({_VERB_ACCENTED}).*?điểm\s+([a-zđ])\s+khoản\s+(\d+)\s+điều\s+(\d+[a-zA-Z]?)",
    rf"({_VERB}).*?diem\s+([a-z])\s+khoan\s+(\d+)\s+dieu\s+(\d+[a-z]?)",
)
_CLAUSE = (
    rf"(?iu)({_VERB_ACCENTED})\s+khoản\s+(.+?)\s*,?\s*điều\s+(\d+[a-zA-Z]?)",
    rf"({_VERB})\s+khoan\s+(.+?)\s*,?\s*dieu\s+(\d+[a-z]?)",
)
_ARTICLE = (rf"(?iu)({_VERB_ACCENTED})\s+điều\s+(\d+[a-zA-Z]?)", rf"({_VERB})\s+dieu\s+(\d+[a-z]?)")
_RENAME = r"(?:sua doi|thay the)\s+ten\s+(.+?)\s+thanh\s+(.+)"
_GENERIC = rf"(?:{_VERB})\s+(?:dieu|khoan|diem)"

AMENDMENT_FIELDS = "struct<action:string,point:string,clause:string,article:string>"


def parse_amendment(title: Column, folded: Column) -> Column:
    """struct(action, point, clause, article) from the first matching title shape; NULL when none matches."""

    def hit(text: Column, pattern: str, point: int, clause: int, article: int) -> Column:
        group = lambda n: strip(F.regexp_extract(text, pattern, n)) if n else F.lit(None).cast("string")
        fields = (
            amendment_action(F.regexp_extract(text, pattern, 1)).alias("action"),
            group(point).alias("point"),
            group(clause).alias("clause"),
            group(article).alias("article"),
        )
        return F.when(text.rlike(pattern), F.struct(*fields))

    nothing = F.lit(None).cast("string")
    bare = lambda action: F.struct(
        action.alias("action"), nothing.alias("point"), nothing.alias("clause"), nothing.alias("article")
    )
    shapes = [
        hit(text, pattern, *groups)
        for patterns, groups in ((_POINT_CLAUSE, (2, 3, 4)), (_CLAUSE, (0, 2, 3)), (_ARTICLE, (0, 0, 2)))
        for text, pattern in zip((title, folded), patterns)
    ]
    return F.coalesce(
        *shapes,
        F.when(folded.rlike(_RENAME), bare(F.lit("rename"))),
        F.when(folded.rlike(_GENERIC), bare(amendment_action(title))),
    )


# --- appendix references ----------------------------------------------------

# The ten numerals that references use.
ROMANS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")
APPENDIX_MENTION = r"(?iu)(?:phụ\s*lục|phu\s*luc)\s+([ivxlcdm]+|\d+)"


def digit_to_roman(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, r in enumerate(ROMANS, 1) for x in (str(i), r)])
    return F.try_element_at(table, F.trim(c))


def roman_to_digit(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, r in enumerate(ROMANS, 1) for x in (r, str(i))])
    return F.try_element_at(table, F.trim(F.upper(c)))


def canonical_appendix(c: Column) -> Column:
    number = F.trim(F.upper(c))
    return F.coalesce(digit_to_roman(number), number)


def appendix_references(text: Column) -> Column:
    """All appendix numbers mentioned, as roman numerals where known, distinct in order."""
    found = F.regexp_extract_all(text, F.lit(APPENDIX_MENTION), F.lit(1))
    return F.array_distinct(F.transform(found, canonical_appendix))


def appendix_patterns(ref: Column) -> Column:
    """The six path spellings of a reference, for the numeral and its digit form."""
    spellings = ("Phụ lục", "PHỤ LỤC", "phụ lục", "Phu luc", "PHU LUC", "phu luc")
    refs = F.array_compact(F.array(ref, roman_to_digit(ref)))
    per_ref = F.transform(
        refs, lambda r: F.array(*[F.concat(F.lit(f"%{s} "), r, F.lit("%")) for s in spellings])
    )
    return F.array_distinct(F.flatten(per_ref))
