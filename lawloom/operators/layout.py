"""Page layout: nested JSON to entries, page texts, and matching of lines to boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions.text import collapse, fold, let, strip
from lawloom.session import materialize

ID = "doc_id"

_SPAN = "struct<type:string,content:string,bbox:array<double>>"
_LINE = f"struct<bbox:array<double>,spans:array<{_SPAN}>>"
# Child blocks stay JSON text, which unrolls the recursion level by level.
_BLOCKS = f"array<struct<bbox:array<double>,lines:array<{_LINE}>,blocks:string>>"
_PAGE = (
    f"struct<page_idx:int,page_size:string,size:string,width:double,height:double,page_width:double,"
    f"page_height:double,para_blocks:{_BLOCKS},preproc_blocks:{_BLOCKS}>"
)
LAYOUT = f"struct<pdf_info:array<{_PAGE}>>"
FIRST_LEVELS = 2  # levels of child blocks that are tried first

OCR_LINE = "result struct<layoutParsingResults:array<struct<markdown:struct<text:string>>>>"


def layout_match_text(c: Column) -> Column:
    return fold(collapse(c))


def _page_size(page: Column) -> Column:
    raw = F.coalesce(page["page_size"], page["size"])
    pair = F.from_json(raw, "array<double>")
    named = F.from_json(raw, "struct<width:double,height:double,w:double,h:double>")

    def size(width: Column, height: Column) -> Column:
        both = width.isNotNull() & height.isNotNull()
        return F.when(both, F.struct(width.alias("width"), height.alias("height")))

    return F.coalesce(
        F.when(F.startswith(raw, F.lit("{")), size(F.coalesce(named["width"], named["w"]), F.coalesce(named["height"], named["h"]))),
        F.when(F.startswith(raw, F.lit("[")), size(F.get(pair, F.lit(0)), F.get(pair, F.lit(1)))),
        size(F.coalesce(page["width"], page["page_width"]), F.coalesce(page["height"], page["page_height"])),
    )


def _with_children(block: Column, levels: int) -> Column:
    """The block and its descendants, depth first."""
    own = F.array(F.struct(block["bbox"].alias("bbox"), block["lines"].alias("lines")))
    if levels == 0:
        return own
    kids = F.coalesce(F.from_json(block["blocks"], _BLOCKS), F.array().cast(_BLOCKS))
    return F.concat(own, F.flatten(F.transform(kids, lambda b: _with_children(b, levels - 1))))


def _too_deep(block: Column, levels: int) -> Column:
    kids = F.coalesce(F.from_json(block["blocks"], _BLOCKS), F.array().cast(_BLOCKS))
    if levels == 0:
        return F.size(kids)
    return F.aggregate(kids, F.lit(0), lambda n, b: n + _too_deep(b, levels - 1))


def _pages(layouts: DataFrame, column: str) -> DataFrame:
    """(doc_id, page_no, page, blocks): para_blocks, else preproc_blocks."""
    parsed = layouts.select(ID, F.posexplode(F.from_json(column, LAYOUT)["pdf_info"]).alias("page_no", "page"))
    some = lambda c: F.when(F.size(c) > 0, c)
    blocks = F.coalesce(some(F.col("page.para_blocks")), some(F.col("page.preproc_blocks")))
    return parsed.withColumn("blocks", blocks)


def nesting(layouts: DataFrame, column: str = "layout") -> int:
    """Levels of child blocks that hold all blocks of all layouts: twice as many, until no block lies deeper. Layouts
    without the key of child blocks, escaped or not, have none and need not be parsed."""
    named = F.contains(F.col(column), F.lit('"blocks"')) | F.contains(F.col(column), F.lit("\\u"))
    levels, pages = FIRST_LEVELS, _pages(layouts.filter(named), column)
    while not pages.filter(F.exists("blocks", lambda b: _too_deep(b, levels) > 0)).isEmpty():  # noqa: B023
        levels *= 2
    return levels


def _long(text: Column, least: int) -> Column:
    """The text where it has so many characters, no row else. A filter would compute the text once more."""
    return F.explode(F.filter(F.array(text), lambda x: F.length(x) >= least))


_ENTRY = "array<struct<text:string,bbox:array<double>>>"


def _block_entries(block: Column) -> Column:
    box = lambda c: F.when(F.size(c) > 0, c)
    entry = lambda text, bbox: F.struct(text.alias("text"), bbox.alias("bbox"))
    none = F.array().cast(_ENTRY)

    def spans(line: Column) -> Column:
        found = F.filter(
            F.coalesce(line["spans"], F.array().cast(f"array<{_SPAN}>")),
            lambda s: (s["type"] == "text") & (s["content"] != ""),
        )
        return F.filter(found, lambda s: s.isNotNull())

    def line_entries(line: Column) -> Column:
        def build(sp: Column) -> Column:
            each = F.transform(
                sp, lambda s: entry(s["content"], F.coalesce(box(s["bbox"]), box(line["bbox"]), box(block["bbox"])))
            )
            whole = entry(
                F.array_join(F.transform(sp, lambda s: s["content"]), " "),
                F.coalesce(box(line["bbox"]), box(block["bbox"])),
            )
            return F.concat(each, F.when(F.size(sp) > 1, F.array(whole)).otherwise(none))

        return let(spans(line), build)

    lines = F.coalesce(block["lines"], F.array().cast(f"array<{_LINE}>"))
    texts = F.flatten(F.transform(lines, lambda ln: F.transform(spans(ln), lambda s: s["content"])))
    whole = F.array(entry(F.array_join(texts, " "), box(block["bbox"])))
    return F.concat(
        F.flatten(F.transform(lines, line_entries)), F.when(F.size(texts) > 0, whole).otherwise(none)
    )


def _with_folded(entries: Column) -> Column:
    """The entries with their match texts; an entry with the text of the one before it, as the block of a single span
    has, takes that one's."""

    def own(e: Column, i: Column) -> Column:
        return F.when(~F.coalesce(F.get(entries, i - 1)["text"] == e["text"], F.lit(False)), layout_match_text(e["text"]))

    def all_of(folded: Column) -> Column:
        known = lambda e, i: F.coalesce(F.get(folded, i), F.when(e["text"].isNotNull(), F.get(folded, i - 1)), layout_match_text(e["text"]))
        return F.transform(entries, lambda e, i: F.struct(e["text"].alias("text"), e["bbox"].alias("bbox"), known(e, i).alias("folded")))

    return let(F.transform(entries, own), all_of)


def layout_entries(layouts: DataFrame, column: str = "layout", levels: int | None = None) -> DataFrame:
    """(doc_id, entry_no, text, folded, bbox, page_idx, page_size) at span, line and block level, in reading order.

    Child blocks are read to any depth; ``levels`` saves the measurement where the depth is known."""
    if levels is None:  # read twice
        layouts = materialize(layouts.select(ID, column), "layouts")
    depth = nesting(layouts, column) if levels is None else levels
    entries = F.flatten(F.transform("blocks", lambda b: F.flatten(F.transform(_with_children(b, depth), _block_entries))))
    rows = _pages(layouts, column).withColumn("size", _page_size(F.col("page"))).select(
        ID, "page_no", "page.page_idx", "size", F.posexplode(let(entries, _with_folded)).alias("n", "e")
    )
    return (
        rows.filter(F.col("e.bbox").isNotNull())
        .select("*", _long(F.col("e.folded"), 1).alias("folded"))
        .select(
            ID,
            (F.col("page_no").cast("bigint") * 1_000_000_000 + F.col("n")).alias("entry_no"),
            "e.text",
            "folded",
            "e.bbox",
            F.coalesce("page_idx", F.lit(0)).alias("page_idx"),
            F.col("size").alias("page_size"),
        )
    )


def layout_pages(layouts: DataFrame, column: str = "layout", levels: int | None = None) -> DataFrame:
    """(doc_id, page_no from 1, text): spans one per line, blocks separated by a blank line."""
    if levels is None:  # read twice
        layouts = materialize(layouts.select(ID, column), "layouts")
    depth = nesting(layouts, column) if levels is None else levels
    contents = lambda line: F.transform(
        F.coalesce(line["spans"], F.array().cast(f"array<{_SPAN}>")), lambda s: strip(s["content"])
    )

    def block_text(block: Column) -> Column:
        parts = F.flatten(
            F.transform(
                _with_children(block, depth),
                lambda b: F.flatten(F.transform(F.coalesce(b["lines"], F.array().cast(f"array<{_LINE}>")), contents)),
            )
        )
        return strip(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n"))

    texts = F.filter(F.transform("blocks", block_text), lambda x: x != "")
    page = F.coalesce(strip(F.array_join(texts, "\n\n")), F.lit(""))
    return _pages(layouts, column).select(ID, (F.col("page_no") + 1).alias("page_no"), page.alias("text"))


def pages_to_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, raw_text, page_count, ocr_pages): pages joined by a blank line; ocr_pages have text."""
    return pages.groupBy(ID).agg(
        strip(F.expr("listagg(text, '\\n\\n') WITHIN GROUP (ORDER BY page_no)")).alias("raw_text"),
        F.count("*").alias("page_count"),
        F.array_sort(F.collect_list(F.when(strip(F.col("text")) != "", F.col("page_no")))).alias("ocr_pages"),
    )


def ocr_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) from OCR result lines (doc_id, line_no, json); pages count through all lines."""
    parsed = lines.filter(strip(F.col("json")) != "").withColumn("r", F.from_json("json", OCR_LINE))
    pages = F.transform(
        F.coalesce("r.result.layoutParsingResults", F.array().cast("array<struct<markdown:struct<text:string>>>")),
        lambda p: F.coalesce(p["markdown"]["text"], F.lit("")),
    )
    per_doc = (
        parsed.groupBy(ID)
        .agg(F.array_sort(F.collect_list(F.struct("line_no", pages.alias("pages")))).alias("ls"))
        .select(ID, F.posexplode(F.flatten(F.transform("ls", lambda x: x["pages"]))).alias("i", "text"))
    )
    return per_doc.select(ID, (F.col("i") + 1).alias("page_no"), "text")


# --- matching lines to entries -------------------------------------------------------

MIN_LINE, MIN_ENTRY, MIN_CONTAINED = 10, 8, 20


def _near_texts(texts: list[str], line: list[bool], entry: list[bool]) -> list[list[int]]:
    """For each text that is a line, the places of the entries that equal it, contain it or lie in it. The texts of a
    document are distinct; a text is looked for where its first characters occur."""
    near = [[i] if line[i] and entry[i] else [] for i in range(len(texts))]
    starts: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        if len(t) >= MIN_CONTAINED:
            starts.setdefault(t[:MIN_CONTAINED], []).append(i)
    for o, t in enumerate(texts):
        if 4 * len(starts) < len(t):  # few starts: each is looked for; else every run of characters is looked up
            seen = [x for x in starts if x in t]
        else:
            seen = {x for k in range(len(t) - MIN_CONTAINED + 1) if (x := t[k : k + MIN_CONTAINED]) in starts}
        for g in seen:
            for i in starts[g]:
                if i != o and ((line[i] and entry[o]) or (line[o] and entry[i])) and texts[i] in t:
                    if line[i] and entry[o]:
                        near[i].append(o)
                    if line[o] and entry[i]:
                        near[o].append(i)
    return near


def _near(texts: pd.Series, line: pd.Series, entry: pd.Series) -> pd.Series:
    return pd.Series([_near_texts(list(t), list(a), list(b)) for t, a, b in zip(texts, line, entry)], dtype=object)


def _matched(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, text, of, found): each text of lines with what its lines are of, and the texts and payloads of the entries
    that match it. ``lines``: doc_id, text, of (a struct); ``entries``: doc_id, text, box (a struct).

    Lines and entries are dealt by document once, and all that follows is keyed by it; a document's texts are one row.
    """
    of, box = lines.schema["of"].dataType, entries.schema["box"].dataType
    sides = lines.select(ID, "text", "of", F.lit(None).cast(box).alias("box")).unionByName(
        entries.select(ID, "text", F.lit(None).cast(of).alias("of"), "box")
    )
    texts = sides.filter(F.col(ID).isNotNull()).repartition(ID).groupBy(ID, "text").agg(
        F.collect_set("of").alias("of"), F.collect_set("box").alias("box")
    )
    docs = texts.groupBy(ID).agg(F.collect_list(F.struct("text", "of", "box")).alias("t"))
    has = lambda name: F.transform("t", lambda x: F.size(x[name]) > 0)
    near = F.pandas_udf(_near, "array<array<int>>")(F.transform("t", lambda x: x["text"]), has("of"), has("box"))
    some = lambda name: F.exists("t", lambda x: F.size(x[name]) > 0)
    found = F.zip_with(
        "t", "near",
        lambda x, near: F.struct(
            x["text"].alias("text"), x["of"].alias("of"),
            F.transform(near, lambda k: F.get("t", k)).alias("found"),
        ),
    )
    hit = F.filter(found, lambda x: F.size(x["found"]) > 0)
    return docs.filter(some("of") & some("box")).withColumn("near", near).select(ID, F.explode(hit).alias("m")).select(
        ID, "m.text", "m.of", "m.found"
    )


def match_texts(line_texts: DataFrame, entry_texts: DataFrame) -> DataFrame:
    """(doc_id, line, entry) of distinct folded texts that are equal or contain each other."""
    there = F.struct(F.lit(True).alias("there"))
    side = lambda rows, c, least, name: rows.filter(F.length(c) >= least).select(ID, F.col(c).alias("text"), there.alias(name))
    found = _matched(side(line_texts, "line", MIN_LINE, "of"), side(entry_texts, "entry", MIN_ENTRY, "box"))
    return found.select(ID, F.col("text").alias("line"), F.explode(F.transform("found", lambda x: x["text"])).alias("entry"))


def lines_to_layout(lines: DataFrame, entries: DataFrame, unit: list[str]) -> DataFrame:
    """Distinct (doc_id, unit columns, bbox, page_idx, page_size) that the lines of each unit match.

    Texts are matched once per document however often they repeat. ``lines``: doc_id, unit columns, line.
    """
    folded = lines.select(ID, _long(layout_match_text(F.col("line")), MIN_LINE).alias("text"), F.struct(*unit).alias("of"))
    boxes = entries.select(ID, _long(F.col("folded"), MIN_ENTRY).alias("text"), F.struct("bbox", "page_idx", "page_size").alias("box"))
    found = _matched(folded, boxes)
    per_text = found.select(ID, "of", F.array_distinct(F.flatten(F.transform("found", lambda x: x["box"]))).alias("box"))
    rows = per_text.select(ID, "of", F.explode("box").alias("b")).select(ID, F.explode("of").alias("u"), "b")
    return rows.select(ID, "u.*", "b.*").distinct()


def layout_payload(matches: DataFrame, unit: list[str]) -> DataFrame:
    """Boxes, page sizes and page numbers per unit (block, section or chunk)."""
    pages = F.map_from_entries(
        F.array_sort(F.collect_set(F.when(F.col("page_size").isNotNull(), F.struct("page_idx", "page_size"))))
    )
    sized = matches.groupBy(ID, *unit, "page_idx").agg(
        F.max("page_size").alias("page_size"), F.collect_set("bbox").alias("b")
    )
    return sized.groupBy(ID, *unit).agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("page_idx", F.array_sort("b").alias("b")))),
                lambda p: F.transform(p["b"], lambda b: F.struct(b.alias("bbox"), p["page_idx"].alias("page_idx"))),
            )
        ).alias("bboxes"),
        pages.alias("page_sizes"),
        F.array_sort(F.collect_set("page_idx")).alias("page_indices"),
    )


def attach_layout(parsed: DataFrame, lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Boxes, page sizes and page numbers of each parsed chunk; NULL where no line matches.

    ``lines``: doc_id, block_id, item, line; item is NULL for lines that count for every chunk of their block. A chunk of
    block 0 takes the boxes of all its ``items`` (of its item, where ``parsed`` has no such column or it is NULL).
    """
    matches = materialize(lines_to_layout(lines, entries, ["block_id", "item"]), "matches")
    own = F.array("item")
    items = F.coalesce("items", own) if "items" in parsed.columns else own
    units = parsed.filter("block_id = 0").select(ID, F.col("item").alias("head"), F.explode(items).alias("item"))
    free = matches.filter("block_id = 0").join(units, [ID, "item"]).withColumn("item", F.col("head")).drop("head")
    found = layout_payload(matches.filter("block_id > 0").unionByName(free.select(matches.columns)), ["block_id", "item"])
    found = found.withColumnsRenamed({ID: "__d", "block_id": "__b", "item": "__i"})
    item = F.when(F.col("block_id") == 0, F.col("item"))
    same = (F.col(ID) == F.col("__d")) & (F.col("block_id") == F.col("__b")) & item.eqNullSafe(F.col("__i"))
    return parsed.join(found, same, "left").drop("__d", "__b", "__i")
