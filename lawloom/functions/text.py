"""Text normalisation as Column -> Column expressions (no Python workers, no shuffle).

A document is one row, so every rule below works inside the row: lines are an
array, and rules that look at the previous line zip the array with itself
shifted by one. Nothing here explodes or moves text between executors.
"""

from __future__ import annotations

import html.entities
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's notion of white space: Unicode White_Space plus the four ASCII separators.
WS = r"[\s\x1c-\x1f]"
# End of a word that started with a letter or digit (`\b` differs between regex engines).
WORD_END = r"(?:[^\p{L}\p{N}_]|$)"
WORD_START = r"(?:^|[^\p{L}\p{N}_])"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chained(c: Column, *steps: Callable[[Column], Column]) -> Column:
    """Apply steps one after the other, each result bound once, so that the expression grows linearly."""
    for step in steps:
        c = let(c, step)
    return c


def with_previous(lines: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Map ``body(line, previous line)`` over an array; the first line has previous = NULL."""
    return let(
        lines,
        lambda a: F.zip_with(
            a,
            F.slice(F.concat(F.array(F.lit(None).cast("string")), a), F.lit(1), F.size(a)),
            body,
        ),
    )


# The same characters written out, which is faster to match.
_BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Matched once from the start: a pattern for either end would be tried at every character."""
    return F.regexp_extract(c, rf"(?s)\A[{_BLANK}]*+(.*[^{_BLANK}])", 1)


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


# --- accent folding -------------------------------------------------------


_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose decomposition without marks is one other character, that character, and the rest as a map.

    Hangul syllables are left out: they decompose by arithmetic."""
    source, target, longer = [], [], {}
    for cp in range(0x00C0, 0x110000):
        ch = chr(cp)
        if unicodedata.decomposition(ch).startswith("<") or not unicodedata.decomposition(ch) or ch != ch.lower():
            continue
        if _HANGUL_FIRST <= cp <= _HANGUL_LAST:
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
        elif base != ch and base:
            longer[ch] = base
    return "".join(source) + "đ", "".join(target) + "d", longer


_FOLD_FROM, _FOLD_TO, _FOLD_LONGER = _fold_tables()
_LEADS, _VOWELS, _TAILS = ("".join(map(chr, range(a, b))) for a, b in ((0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3)))
_SYLLABLE = f"[{chr(_HANGUL_FIRST)}-{chr(_HANGUL_LAST)}]"
# Scripts with such characters: few plain ranges, which cost little to look for.
_DECOMPOSED = "[\u0900-\u1cff\uac00-\ud7a3\U00011000-\U0001d1ff]"


def literal_map(entries: dict[str, str]) -> Column:
    """A constant map as one expression that is folded once, where a call with all entries would be planned entry by entry."""
    between, after = "\u0001", "\u0002"
    return F.str_to_map(F.lit(after.join(f"{k}{between}{v}" for k, v in entries.items())), F.lit(after), F.lit(between))


def _decomposed(ch: Column) -> Column:
    """One character as the several that it decomposes into."""
    s = F.ascii(ch) - _HANGUL_FIRST
    pick = lambda letters, at: F.substring(F.lit(letters), at.cast("int") + 1, F.lit(1))
    tail = F.when(s % 28 != 0, pick(_TAILS, s % 28 - 1)).otherwise("")
    syllable = F.concat(pick(_LEADS, F.floor(s / 588)), pick(_VOWELS, F.floor(s % 588 / 28)), tail)
    other = literal_map(_FOLD_LONGER)
    return F.when(ch.rlike(_SYLLABLE), syllable).otherwise(F.coalesce(F.try_element_at(other, ch), ch))


def fold(c: Column) -> Column:
    """Lower case, canonically decomposed, without marks, over all of Unicode; d-stroke becomes d."""

    def plain(x: Column) -> Column:
        return F.regexp_replace(F.translate(F.lower(x), _FOLD_FROM, _FOLD_TO), r"\p{Mn}+", "")

    def spread(x: Column) -> Column:
        return F.array_join(F.transform(F.split(F.lower(x), ""), _decomposed), "")

    return let(
        c,
        lambda x: F.when(~x.rlike(r"[^\x00-\x7f]"), F.lower(x))  # nothing else to do for plain letters
        .when(x.rlike(_DECOMPOSED), plain(spread(x)))
        .otherwise(plain(x)),
    )


def collapse(c: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(c, rf"(?U){WS}+", " "))


def fold_collapsed(c: Column) -> Column:
    return collapse(fold(c))


def keyword_text(c: Column) -> Column:
    """Folded text where everything outside [a-z0-9] is one space. Folded by lines, as those of plain letters cost little."""
    folded = F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), fold), " ")
    return F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " "))


# --- cleaning -------------------------------------------------------------


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def normalize_spaces(c: Column) -> Column:
    return F.regexp_replace(c, "[ \\t\u00a0]+", " ")


def stripped_lines(c: Column) -> Column:
    return F.transform(F.split(c, "\n"), strip)


def text_lines(c: Column) -> Column:
    """Split like Python's splitlines()."""
    return F.split(c, LINE_BREAK)


def drop_extra_blank_lines(lines: Column) -> Column:
    kept = with_previous(
        lines,
        lambda x, prev: F.struct(x.alias("x"), (~((x == "") & F.coalesce(prev == "", F.lit(False)))).alias("keep")),
    )
    return F.transform(F.filter(kept, lambda p: p["keep"]), lambda p: p["x"])


# Heading words with and without accents, one known misreading, and bullet marks.
CLEAN_HEADING = (
    rf"(?iu)^(?:(?:chương|chuong)\s+[ivxlcdm0-9]+|(?:mục|muc|mic)\s+\d+|(?:điều|dieu)\s+\d+){WORD_END}"
)
CLEAN_BULLET = r"^\s*(?:\d+\.|[a-z]\)|-|\+)\s+"
SENTENCE_END = r"[.:;?!]\z"


def is_heading(line: Column) -> Column:
    return line.rlike(CLEAN_HEADING)


def is_bullet(line: Column) -> Column:
    return line.rlike(CLEAN_BULLET)


def _starts_line(x: Column, prev: Column) -> Column:
    solo = (x == "") | is_heading(x) | is_bullet(x)
    after_break = (prev == "") | is_heading(prev) | prev.rlike(SENTENCE_END)
    return prev.isNull() | solo | after_break


def _glued(lines: Column) -> Column:
    glue = lambda x, prev: F.concat(F.when(_starts_line(x, prev), F.lit("\n")).otherwise(F.lit(" ")), x)
    return F.array_join(with_previous(lines, glue), "")


def merge_broken_lines(lines: Column) -> Column:
    """Join lines broken inside a sentence; the result is an array of lines."""
    return F.split(F.substring(_glued(lines), 2, 2**31 - 1), "\n")


def clean(c: Column) -> Column:
    """The whole cleaning chain. The final blank-run collapse subsumes dropping extra blank lines."""
    lines = stripped_lines(normalize_spaces(normalize_newlines(F.coalesce(c, F.lit("")))))
    text = F.regexp_replace(F.regexp_replace(_glued(lines), "\n{3,}", "\n\n"), " {2,}", " ")
    return strip(text)


# --- parser text utilities ------------------------------------------------


def _has_any(c: Column, *marks: str) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(c, F.lit(mark))
    return found


def normalize_gaps(c: Column) -> Column:
    """Runs of blanks and tabs to one blank."""
    return F.when(_has_any(c, "\t", "  "), F.regexp_replace(c, "[ \\t]+", " ")).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Most texts are in order, which is quick to see."""

    def ordered(x: Column) -> Column:
        spaced = F.regexp_replace(normalize_newlines(x), "[ \\t]+", " ")
        fresh = F.regexp_replace(spaced, "\n{3,}", "\n\n")
        return F.when(_has_any(x, "\r", "\t", "  ", "\n\n\n"), fresh).otherwise(x)

    return strip(let(c, ordered))


def strip_md_heading(line: Column) -> Column:
    return strip(F.regexp_replace(line, rf"(?U)\A{WS}*#{{1,6}}{WS}*", ""))


def is_page_number(line: Column) -> Column:
    return strip(line).rlike(r"(?U)\A\d{1,3}\z")


# What is left of a line without blanks around it and a heading mark, unless that is a page number.
_CONTENT = rf"(?s)\A[{_BLANK}]*+(?:#{{1,6}}+[{_BLANK}]*+)?+(?!\p{{Nd}}{{1,3}}[{_BLANK}]*+\z)(.*[^{_BLANK}])"


def parser_line(raw: Column) -> Column:
    """A stripped line without its markdown heading mark, NULL when it carries no content."""
    return let(F.regexp_extract(raw, _CONTENT, 1), lambda x: F.when(x != "", x))


def fallback_title(c: Column) -> Column:
    first = F.get(F.filter(F.transform(text_lines(c), parser_line), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(F.left(first, F.lit(180)), F.lit("Untitled"))


def preview(c: Column, limit: int = 160) -> Column:
    return F.when(c != "", F.left(collapse(c), F.lit(limit)))


def generated_title(c: Column) -> Column:
    return F.left(collapse(c), F.lit(80))


def clean_title(c: Column) -> Column:
    return F.nullif(F.left(strip(F.coalesce(c, F.lit(""))), F.lit(255)), F.lit(""))


# --- repairs that run before segmentation -----------------------------------

# Misread spellings of the article keyword.
MISREAD_ARTICLE = rf"(?iu)({WORD_START})(?:điểu|diểu|diều|dieu)\s+(\d+[a-zA-Z]?)(?![\p{{L}}\p{{N}}_])"
# Plain classes for its first letters, which fail fast in texts without such a word; after đ only ể is a misreading.
_MAY_BE_MISREAD = r"[đĐdD][iIıİ](?:(?iu:ể)|(?<=[dD][iIıİ])(?iu:[ềe]))(?iu:u\s+\d)"
# Loosely read legal actions, tested on folded text.
LOOSE_ACTION = (
    r"(?U)s\w{0,2}a\s+d\w{0,2}i|b\w{0,2}\s+sung|b\w{0,2}i\s+b\w{0,2}|thay\s+th\w{0,2}"
    r"|dieu\s+\d+|khoan\s+.+?\s+dieu\s+\d+"
)


def _repair_section_sign(line: Column) -> Column:
    def acts(x: Column) -> Column:
        rest = F.regexp_extract(x, r"§\s*\.?\s*(.+)$", 1)
        return (rest != "") & fold(rest).rlike(LOOSE_ACTION)

    opens = r"(?U)\A\s*§"
    leading = F.when(
        line.rlike(opens) & acts(line), F.regexp_replace(line, r"(?U)\A\s*§\s*\.?\s*", "8. ")
    ).otherwise(line)
    return let(
        leading,
        lambda x: F.when(
            ~x.rlike(opens) & acts(x), F.regexp_replace(x, r"(?U)\s*§\s*\.?\s*(.+)$", "\n8. $1")
        ).otherwise(x),
    )


def repair_ocr(c: Column) -> Column:
    """Misread article keywords, and section signs that stand for an amendment item."""


    def signs(text: Column) -> Column:
        repaired = F.array_join(F.transform(text_lines(text), _repair_section_sign), "\n")
        return F.when(F.contains(text, F.lit("§")), repaired).otherwise(text)

    misread = F.when(c.rlike(_MAY_BE_MISREAD), F.regexp_replace(c, MISREAD_ARTICLE, "$1Điều $2")).otherwise(c)
    return let(misread, signs)


# Words that follow a numbered item in regulation text.
FOOTNOTE_WORDS = "Đối|Doi|Trường|Truong|Sinh|Nếu|Neu|Chứng|Chung|Thời|Thoi"


def drop_footnote_markers(c: Column) -> Column:
    pattern = rf"(?miu)^(\s*\d+)\.\d{{1,2}}\s+((?:{FOOTNOTE_WORDS})(?:[^\p{{L}}\p{{N}}_]|$))"
    return F.when(c.rlike(r"\d\.\d"), F.regexp_replace(c, pattern, "$1. $2")).otherwise(c)


_BLOCK = r"(?is)<(?:div|p|center|h[1-6])\b[^>]*>.*?</(?:div|p|center|h[1-6])>"
_INLINE = r"(?i)</?(?:span|strong|b|i|em|u)\b[^>]*>"
_HIDDEN = r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|template)\b[^>]*>.*?</\1>"
_MARK_OPEN, _MARK_CLOSE, _MARK_TAG = "\u0001", "\u0002", "\u0003"


def _entity_map() -> Column:
    return literal_map({"apos": "'"} | {name: chr(cp) for name, cp in sorted(html.entities.name2codepoint.items())})


def _from_code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def unescape(c: Column) -> Column:
    """Named and numeric character references to characters."""

    def character(ref: Column) -> Column:
        hexadecimal = ref.rlike("^#[xX]")
        digits = F.regexp_extract(ref, r"\A#[xX]?0*([0-9a-fA-F]*)\z", 1)
        short = F.length(digits) <= 7
        number = F.when(hexadecimal & short, F.conv(digits, 16, 10)).when(short, digits).try_cast("bigint")
        valid = lambda n: n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        numeric = let(number, lambda n: F.when(valid(n), _from_code_point(n)).otherwise(F.lit("\ufffd")))
        return F.when(F.startswith(ref, F.lit("#")), numeric).otherwise(F.try_element_at(_entity_map(), ref))

    def replaced(x: Column, ref: Column) -> Column:
        tail = F.substring(x, F.length(ref) + 2, F.lit(2**31 - 1))
        return let(
            F.when(ref != "", character(ref)),
            lambda ch: F.when(ch.isNull(), F.concat(F.lit("&"), x)).otherwise(F.concat(ch, tail)),
        )

    def piece(x: Column, i: Column) -> Column:
        ref = F.regexp_extract(x, r"\A(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", 1)
        return F.when(i == 0, x).otherwise(let(ref, lambda r: replaced(x, r)))

    decoded = F.array_join(F.transform(F.split(c, "&"), piece), "")
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def visible_text(markup: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(markup, _HIDDEN, _MARK_TAG), r"(?s)<[/a-zA-Z!][^>]*>", _MARK_TAG)
    parts = F.transform(F.split(marked, _MARK_TAG), lambda x: strip(unescape(x)))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def html_blocks_to_text(c: Column) -> Column:
    """Block elements become lines of their own; stray inline tags vanish, their text stays."""
    marked = F.regexp_replace(c, f"({_BLOCK})", f"{_MARK_OPEN}$1{_MARK_CLOSE}")

    def piece(x: Column, i: Column) -> Column:
        shown = lambda t: F.when(t == "", F.lit("\n")).otherwise(F.concat(F.lit("\n"), t, F.lit("\n")))
        return F.when(i % 2 == 1, let(visible_text(x), shown)).otherwise(x)

    blocks = F.array_join(F.transform(F.split(marked, f"[{_MARK_OPEN}{_MARK_CLOSE}]"), piece), "")
    return F.when(c.rlike(r"<[/a-zA-Z]"), F.regexp_replace(blocks, _INLINE, "")).otherwise(c)


_APPENDIX_INLINE = r"(?iu)^\s*((?:phụ\s*lục|phu\s*luc)\s+(?:[ivxlcdm]+|\d+))\s+(.+)$"
_MAY_BE_APPENDIX = rf"\A[{_BLANK}]*+[pP][hH]"
_NUMBERED_TAIL = r"(?s)^(.*?)(\s+\d+\.\s+.+)$"


def _joined(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.nullif(strip(p), F.lit("")) for p in parts])), "\n")


def _split_appendix_line(raw: Column) -> Column:
    line = strip(raw)
    head, rest = F.regexp_extract(line, _APPENDIX_INLINE, 1), strip(F.regexp_extract(line, _APPENDIX_INLINE, 2))
    tail = F.regexp_extract(rest, _NUMBERED_TAIL, 2)
    with_tail = _joined(head, F.regexp_extract(rest, _NUMBERED_TAIL, 1), tail)
    split = F.when(head == "", raw).when(tail != "", with_tail).otherwise(_joined(head, rest))
    return F.when(raw.rlike(_MAY_BE_APPENDIX), split).otherwise(raw)  # lines that start otherwise have no such head


def split_appendix_titles(c: Column) -> Column:
    out = F.array_join(F.transform(text_lines(c), _split_appendix_line), "\n")
    # the first test has no branches to try at every letter
    return F.when(c.rlike(r"(?iu)ph[ụu]\s*l[ụu]c\s") & c.rlike(r"(?iu)(?:phụ\s*lục|phu\s*luc)\s"), out).otherwise(c)


_TRAILING_HEADING = r"(?iu)^(.{20,}?)\s+(\d+\.\s+[A-ZÀ-Ỵa-zà-ỵ][^\n]{1,80})$"
# Folded phrases whose lines may hide a numbered heading at the end.
TRAILING_PHRASES = "bang quy doi|khung nang luc|phu luc"


# White space within a line, after some text.
_TRAILING_NUMBER = r"\S[^\S\n]+\d+\.\s"


def _split_trailing_line(raw: Column) -> Column:
    def split(line: Column) -> Column:
        before = strip(F.regexp_extract(line, _TRAILING_HEADING, 1))
        heading = strip(F.regexp_extract(line, _TRAILING_HEADING, 2))
        return let(
            before,
            lambda b: F.when((b != "") & fold(b).rlike(TRAILING_PHRASES), F.concat(b, F.lit("\n"), heading)).otherwise(raw),
        )

    # a numbered heading must follow, which is cheap to test, and the phrase must be in the line
    possible = raw.rlike(_TRAILING_NUMBER) & raw.rlike(may_fold_to(TRAILING_PHRASES)) & fold(raw).rlike(TRAILING_PHRASES)
    return F.when(possible, let(strip(raw), split)).otherwise(raw)


def split_trailing_headings(c: Column) -> Column:
    out = F.array_join(F.transform(text_lines(c), _split_trailing_line), "\n")
    # no line can change without such a number, but line breaks of other kinds become line feeds
    possible = c.rlike(_TRAILING_NUMBER) | c.rlike(r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    phrase = fold(c).rlike(TRAILING_PHRASES)
    # few texts may have the phrase, and to look for it costs less than to look for breaks
    return F.when(c.rlike(may_fold_to(TRAILING_PHRASES)) & possible & phrase, out).otherwise(c)


# Folded words that turn an article mention into a reference.
REFERENCE_WORDS = ("theo", "tai", "xem", "can cu")
# Fixed value: characters before a mention that are searched for such a word.
LOOK_BEHIND = 80


def any_accent(phrase: str) -> str:
    """A pattern that matches the phrase, in lower case, with any accents on its letters."""
    variants = dict.fromkeys(_FOLD_TO, "")
    for ch, base in zip(_FOLD_FROM, _FOLD_TO):
        variants[base] += ch
    gap = rf"\s{{1,{LOOK_BEHIND}}}"  # a look-behind needs a bound: the characters that are looked at
    return "".join(gap if ch == " " else f"[{ch}{variants.get(ch, '')}]\\p{{Mn}}{{0,8}}" for ch in phrase)


def may_fold_to(phrases: str) -> str:
    """A pattern, quick to look for, that every text has whose folded form holds one of the phrases (split by |): each
    plain letter may be any character that is not ASCII, and marks may follow."""
    other = r"\x80-\x{10ffff}"
    letter = lambda ch: (ch if ch == " " else f"[{ch}{ch.upper()}{other}]") + r"\p{Mn}*"
    words = phrases.split("|")
    first = "".join(sorted({w[0] + w[0].upper() for w in words}))
    return f"(?=[{first}{other}])(?:" + "|".join("".join(map(letter, w)) for w in words) + ")"


_REFERENCE = "|".join(any_accent(w) for w in REFERENCE_WORDS)
# The look-ahead comes first: most gaps between words fail it at once.
_INLINE_ARTICLE = (
    r"(?iu)(?<=\S)(?=[^\S\n]+(?:điều|dieu)\s+\d)"
    rf"(?<!(?:^|[^\p{{L}}\p{{N}}_])(?:{_REFERENCE}))[^\S\n]+((?:điều|dieu)\s+\d+[a-zA-Z]?\s*[.:]\s*)"
)


def split_inline_headings(c: Column) -> Column:
    """A line break before an article heading inside a line, unless it is a reference to that article."""
    hidden = c.rlike(r"[ \t\x0b\f\r][đĐdD](?iu:i[ềe]u)\s+\d+(?iu:[a-z]?)\s*[.:]")
    return F.when(hidden, F.regexp_replace(c, _INLINE_ARTICLE, "\n$1")).otherwise(c)
