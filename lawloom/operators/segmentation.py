"""Lines to blocks to parsed chunks.

Documents are hash-partitioned by id once, before their lines are exploded.
Explode keeps that partitioning, every later window and group has the document
id among its keys, so no further shuffle of text happens. A document is one
cell of the input, which bounds the size of each window group. There are as many
partitions as the characters need, so that the sorts of a task stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawloom.functions import legal as L
from lawloom.functions import text as T
from lawloom.functions.tables import html_tables_to_markdown
from lawloom.operators.directory import directory_chunks, directory_lines, is_directory, may_be_directory

ID = "doc_id"
# Characters of text in one partition; a task holds some tens of bytes for each in its sorts.
PARTITION_CHARS = 4_000_000
# Split after each line break, so that the pieces still add up to the text.
KEEP_BREAK = r"(?<=[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])"


def prepare_text(c: Column) -> Column:
    """Repairs in their fixed order: normalise, OCR, footnotes, tables, blocks, then the three heading splits."""
    return T.chained(
        c,
        T.normalize_text,
        T.repair_ocr,
        T.drop_footnote_markers,
        html_tables_to_markdown,
        T.html_blocks_to_text,
        T.split_appendix_titles,
        T.split_trailing_headings,
        T.split_inline_headings,
    )


def _partitions(docs: DataFrame) -> int:
    """As many as the cores, more where the texts are long."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // PARTITION_CHARS))


def document_lines(
    docs: DataFrame, text: Column | None = None, carry: tuple[str, ...] = (), skip_directories: bool = False
) -> DataFrame:
    """(doc_id, line_no, raw, line): ``raw`` with its line break, ``line`` stripped, without its markdown
    mark, and NULL for blank lines and page numbers. ``carry`` columns stay with every line as struct ``doc``."""
    text = F.col("text") if text is None else text
    if skip_directories:
        none = F.array().cast("array<string>")
        pieces = T.let(text, lambda t: F.when(is_directory(t), none).otherwise(F.split(t, KEEP_BREAK)))
    else:
        pieces = F.split(text, KEEP_BREAK)
    return (
        docs.withColumn("doc", F.struct(F.col(ID).alias("id"), *carry))
        .repartition(_partitions(docs), ID)
        .select(ID, "doc", F.posexplode(pieces).alias("line_no", "raw"))
        .withColumn("line", T.parser_line(F.col("raw")))
    )


def section_headings(docs: DataFrame, text: str = "text") -> DataFrame:
    """Chapter, section and article headings with level, number, title and line index. No shuffle."""
    lines = F.transform(T.text_lines(F.col(text)), T.strip)
    found = F.transform(
        lines,
        lambda x, i: F.struct(i.alias("line_index"), x.alias("title"), L.section_heading(x).alias("h")),
    )
    return docs.select(
        ID, F.explode(F.filter(found, lambda s: s["h"].isNotNull())).alias("s")
    ).select(ID, "s.line_index", "s.h.level", "s.h.number", "s.title")


# --- major blocks -----------------------------------------------------------


def _before():
    return Window.partitionBy(ID).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)


def _up_to():
    return Window.partitionBy(ID).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def line_events(lines: DataFrame) -> DataFrame:
    """Adds ``event``: A appendix, P/C/S part, chapter or section, M amendment title, R article, X other,
    N no content."""
    line = F.col("line")
    event = (
        F.when(line.isNull(), "N")
        .when(~F.left(line, F.lit(1)).rlike(L.MAY_BE_EVENT), "X")
        .when(L.is_real_appendix_heading(line), "A")
        .when(line.rlike(L.PART), "P")
        .when(line.rlike(L.CHAPTER), "C")
        .when(line.rlike(L.SECTION), "S")
        .when(L.opens_amendment_title(line), "M")
        .when(line.rlike(L.ARTICLE), "R")
        .otherwise("X")
    )
    return lines.withColumn("event", event)


def _last_line(condition: Column, window) -> Column:
    return F.coalesce(F.max(F.when(condition, F.col("line_no"))).over(window), F.lit(-1))


def block_lines(events: DataFrame) -> DataFrame:
    """Assign lines to article and appendix blocks.

    Adds block_id, ``opens`` (the line is a block title), ``content`` (the line is
    block text) and ``block`` (kind, title, number and heading context).
    """
    event = F.col("event")
    upper = event.isin("P", "C", "S")
    state = (
        events.withColumn("__a", _last_line(event == "A", _before()))
        .withColumn("__r", _last_line(event == "R", _before()))
        .withColumn("__p", _last_line(upper, _before()))
        .withColumn("__m", _last_line(event == "M", _before()))
        .withColumn(
            "kind_before",
            F.when(F.col("__a") > F.col("__r"), "appendix")
            .when((F.col("__r") < 0) | (F.col("__p") > F.col("__r")), "none")
            .otherwise("article"),
        )
    )
    in_appendix = F.col("kind_before") == "appendix"
    sets_context = upper & ~in_appendix
    ends_run = (event == "A") | sets_context | ((event == "R") & in_appendix)
    absorbed = (F.col("kind_before") == "article") & (F.col("__m") > F.col("__run"))
    state = (
        state.withColumn("__run", _last_line(ends_run, _before()))
        .withColumn("opens", (event == "A") | ((event == "R") & ~absorbed))
        .withColumn("content", ~F.col("opens") & ~sets_context & (event != "N") & (F.col("kind_before") != "none"))
    )

    def context(keeps: str, resets: tuple[str, ...]) -> Column:
        cleared = F.struct(F.lit(None).cast("string").alias("t"))
        seen = F.when(sets_context & (event == keeps), F.struct(F.col("line").alias("t"))).when(
            (event == "A") | (sets_context & event.isin(*resets)), cleared
        )
        return F.last(seen, ignorenulls=True).over(_up_to())["t"]

    part = F.last(F.when(sets_context & (event == "P"), F.col("line")), ignorenulls=True).over(_up_to())
    state = (
        state.withColumn("part_title", part)
        .withColumn("chapter_title", context("C", ("P",)))
        .withColumn("section_title", context("S", ("P", "C")))
    )
    number = F.when(event == "A", F.regexp_extract("line", L.APPENDIX, 1)).otherwise(
        F.regexp_extract("line", L.ARTICLE, 1)
    )
    title = F.struct(
        F.when(event == "A", "appendix").otherwise("article").alias("kind"),
        F.col("line").alias("title"),
        F.nullif(number, F.lit("")).alias("number"),
        F.col("part_title"),
        F.col("chapter_title"),
        F.col("section_title"),
    )
    return (
        state.withColumn("block_id", F.count(F.when(F.col("opens"), True)).over(_up_to()))
        .withColumn("block", F.last(F.when(F.col("opens"), title), ignorenulls=True).over(_up_to()))
        .drop("__a", "__r", "__p", "__m", "__run", "kind_before", "part_title", "chapter_title", "section_title")
    )


def _joined_lines(column: str) -> Column:
    return F.expr(f"listagg({column}, '\\n') WITHIN GROUP (ORDER BY line_no)")


def major_blocks(lines: DataFrame) -> DataFrame:
    """One row per block with its text; blocks without text and text outside blocks are dropped."""
    return (
        block_lines(line_events(lines))
        .filter("content")
        .groupBy(ID, "block_id")
        .agg(F.first("block").alias("block"), _joined_lines("line").alias("content"))
        .select(ID, "block_id", "block.*", "content")
    )


# --- items inside a block -----------------------------------------------------


def heading_items(lines: DataFrame, allowed: tuple[str, ...], keys: list[str]) -> DataFrame:
    """Split the lines of each key at the allowed inner headings.

    Lines before the first heading join the first item; an item without text
    shows its title; keys without any heading give no rows.
    """
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    items = (
        lines.filter(F.col("line").isNotNull())
        .withColumn("h", L.accepted_heading(F.col("line"), *allowed))
        .withColumn("headings", F.count("h").over(per_key))
        .withColumn("item", F.greatest(F.count("h").over(running), F.lit(1)))
        .filter("headings > 0")
    )
    text = F.expr("listagg(CASE WHEN h IS NULL THEN line END, '\\n') WITHIN GROUP (ORDER BY line_no)")
    return (
        items.groupBy(*keys, "item")
        .agg(
            F.max(F.when(F.col("h").isNotNull(), F.col("line"))).alias("title"),
            F.max("h.number").alias("number"),
            F.max("h.level").alias("level"),
            text.alias("content"),
        )
        .withColumn("content", F.coalesce(F.nullif("content", F.lit("")), "title"))
    )


def numbered_amendment_items(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Items that start at a numbered amendment title; lines before the first one are dropped."""
    return _amendment_items(lines, keys, L.is_amendment_title(T.fold(F.col("line"))), F.lit(False))


def free_form_items(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Items that start with an amendment verb; a numbered amendment title closes the open item."""
    folded = T.fold(F.col("line"))
    return _amendment_items(lines, keys, L.is_free_form_amendment(folded), L.is_amendment_title(folded))


def _amendment_items(lines: DataFrame, keys: list[str], starts: Column, closes: Column) -> DataFrame:
    running = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        lines.filter(F.col("line").isNotNull())
        .withColumn("starts", starts)
        .withColumn("closes", closes & ~F.col("starts"))
        .withColumn("item", F.count(F.when(F.col("starts"), True)).over(running))
        .withColumn(
            "open", _last_line(F.col("starts"), running) > _last_line(F.col("closes"), running)
        )
        .filter("item > 0 AND open")
    )
    return marked.groupBy(*keys, "item").agg(
        F.max(F.when(F.col("starts"), F.col("line"))).alias("title"),
        F.max(F.when(F.col("starts"), F.nullif(F.regexp_extract("line", L.AMENDMENT_ITEM, 1), F.lit("")))).alias(
            "order_number"
        ),
        F.coalesce(
            F.expr("listagg(CASE WHEN NOT starts THEN line END, '\\n') WITHIN GROUP (ORDER BY line_no)"),
            F.lit(""),
        ).alias("content"),
    )


def item_lines(lines: DataFrame, max_chars: int = L.MAX_CHUNK_CHARS) -> DataFrame:
    """The parsing cascade at line level: adds branch, item, sub and ``starts`` to the kept lines.

    Articles: numbered amendments, else free-form amendments, else the whole
    article, else its clauses when it is too long. Appendices: roman, numbered
    and clause items, long items again by points and bullets. Documents without
    blocks: the same items as sections, else one chunk.
    """
    # windows over whole groups name the order of the running ones, so that one sort serves both
    running, whole = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, Window.unboundedFollowing)
    whole_doc = Window.partitionBy(ID)
    of_block = Window.partitionBy(ID, "block_id").orderBy("line_no")
    per_block, in_block = of_block.rowsBetween(*whole), of_block.rowsBetween(*running)
    of_item = Window.partitionBy(ID, "block_id", "item").orderBy("line_no")
    per_item, in_item = of_item.rowsBetween(*whole), of_item.rowsBetween(*running)

    flag = lambda c: F.max(F.coalesce(c, F.lit(False))).over(per_block)
    again = F.when(F.col("has_block"), T.parser_line(F.col("line"))).otherwise(F.col("line"))
    kind = F.coalesce(F.col("block.kind"), F.lit("none"))

    kept = (
        lines.withColumn("has_block", F.max("content").over(whole_doc))
        .filter(F.col("content") | ~F.col("has_block"))
        .withColumn("block_id", F.when(F.col("has_block"), F.col("block_id")).otherwise(F.lit(0)))
        .withColumn("block", F.when(F.col("has_block"), F.col("block")))
        .withColumn("raw", F.when(~F.col("has_block"), F.col("raw")))  # only whole documents show it
        .withColumn("line2", again)
        .withColumn("is_m", L.opens_amendment_title(F.col("line2")))
        .withColumn("is_f", L.opens_free_form_amendment(F.col("line2")))
        .withColumn("h", L.accepted_heading(F.col("line2"), "roman", "numbered", "clause"))
        .withColumn("chars", F.length(T.normalize_gaps(F.col("line"))))
        .drop("line2")  # parsing the line again costs less than the sorts and windows of one more text
    )
    length = F.sum(F.col("chars") + 1).over(per_block) - 1
    clauses = F.sum(F.when(F.col("h.kind") == "clause", 1).otherwise(0)).over(per_block)
    headed = F.count("h").over(per_block) > 0
    branch = (
        F.when((kind == "article") & flag(F.col("is_m")), "numbered")
        .when((kind == "article") & flag(F.col("is_f")), "free")
        .when((kind == "article") & (length > max_chars) & (clauses > 1), "clause")
        .when(kind == "article", "article")
        .when((kind == "appendix") & headed, "appendix_item")
        .when(kind == "appendix", "appendix")
        .when(headed, "section")
        .otherwise("unknown")
    )
    starts = (
        F.when(F.col("branch") == "numbered", F.col("is_m"))
        .when(F.col("branch") == "free", F.col("is_f"))
        .when(F.col("branch") == "clause", F.col("h.kind") == "clause")
        .when(F.col("branch").isin("appendix_item", "section"), F.col("h").isNotNull())
        .otherwise(F.lit(False))
    )
    amended = F.col("branch").isin("numbered", "free")
    split = F.col("branch").isin("clause", "appendix_item", "section")
    items = (
        kept.withColumn("branch", branch)
        .withColumn("starts", F.coalesce(starts, F.lit(False)))
        .withColumn("item", F.count(F.when(F.col("starts"), True)).over(in_block))
        .filter(~(amended & (F.col("item") == 0)))
        .withColumn("item", F.when(split, F.greatest(F.col("item"), F.lit(1))).otherwise(F.col("item")))
        .withColumn(
            "text",
            F.when(amended | split, again)
            .when(F.col("branch") == "unknown", F.col("raw"))
            .otherwise(F.col("line")),
        )
        .filter(F.col("text").isNotNull())
        .withColumn("item_title", F.max(F.when(F.col("starts"), F.col("text"))).over(per_item))
        .withColumn("item_h", F.max(F.when(F.col("starts"), F.struct("h.level", "h.number"))).over(per_item))
    )
    body = F.when(~F.col("starts"), F.col("text"))
    item_chars = F.coalesce(F.sum(F.length(body) + 1).over(per_item) - 1, F.lit(0))
    subs = (
        items.withColumn("long", (F.col("branch") == "appendix_item") & (item_chars > max_chars))
        .withColumn("line3", F.when(F.col("long") & ~F.col("starts"), T.parser_line(F.col("text"))))
        .withColumn("sub_h", L.accepted_heading(F.col("line3"), "point", "bullet"))
        .withColumn("has_sub", F.count("sub_h").over(per_item) > 0)
        .withColumn(
            "sub", F.when(F.col("has_sub"), F.greatest(F.count("sub_h").over(in_item), F.lit(1))).otherwise(F.lit(0))
        )
        .filter(~(F.col("has_sub") & (F.col("starts") | F.col("line3").isNull())))
        .withColumn("text", F.when(F.col("has_sub"), F.col("line3")).otherwise(F.col("text")))
    )
    return subs.select(
        ID, "doc", "line_no", "line", "has_block", "block_id", "block", "branch", "item", "sub", "starts", "text",
        "item_title", "item_h", "sub_h", "has_sub",
    )


def parse_items(items: DataFrame) -> DataFrame:
    """One row per item: the branches' titles, paths, amendment targets and texts."""
    is_title = F.col("starts") | F.col("sub_h").isNotNull()
    piece = F.when(F.col("branch") == "unknown", F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    parts = {
        "doc": F.first("doc"),
        "block": F.first("block"),
        "branch": F.first("branch"),
        "item_title": F.first("item_title"),
        "item_h": F.first("item_h"),
        "sub_title": F.max(F.when(F.col("sub_h").isNotNull(), F.col("text"))),
        "sub_h": F.max(F.struct("sub_h.level", "sub_h.number")),
        "body": F.expr("listagg(CASE WHEN NOT is_title THEN piece END, '') WITHIN GROUP (ORDER BY line_no)"),
    }
    branch, body, item_title, sub_title = (parts[c] for c in ("branch", "body", "item_title", "sub_title"))
    block_title = parts["block"]["title"]
    amended = branch.isin("numbered", "free")
    path = (
        F.when(branch.isin("clause", "appendix_item"), F.concat_ws(" > ", block_title, item_title, sub_title))
        .when(branch == "section", item_title)
        .when(branch.isin("article", "appendix"), block_title)
    )
    title = F.when(amended, item_title).when(branch == "unknown", T.fallback_title(body)).otherwise(path)
    content = F.when(amended, F.coalesce(body, F.lit(""))).otherwise(F.coalesce(body, sub_title, item_title))

    def named(t: Column) -> Column:
        amendment = T.let(T.fold(t), lambda folded: L.parse_amendment(t, folded))
        return F.struct(t.alias("title"), F.when(amended, amendment).alias("amendment"))

    # A filter passes below a projection with copies of what it tests, never below an aggregate: texts are worked out here.
    grouped = (
        items.withColumn("is_title", is_title)
        .withColumn("piece", piece)
        .groupBy(ID, "block_id", "item", "sub")
        .agg(
            F.struct(
                *[c.alias(name) for name, c in parts.items() if name not in ("body", "sub_title")],
                path.alias("path"),
                T.normalize_text(content).alias("content"),
                T.let(T.collapse(title), named).alias("named"),
            ).alias("found")
        )
    )
    branch, block_title, path = F.col("branch"), F.col("block.title"), F.col("path")
    amended = branch.isin("numbered", "free")
    heading = F.coalesce(F.when(F.col("sub") > 0, F.col("sub_h")), F.col("item_h"))
    article = branch.isin("numbered", "free", "clause", "article")
    appendix = branch.isin("appendix", "appendix_item")
    split = branch.isin("clause", "appendix_item", "section")
    missing = F.col("found.branch").isin("numbered", "free") & F.col("found.named.amendment").isNull()
    parsed = grouped.filter((F.col("found.content") != "") & ~missing).select(
        ID, "block_id", "item", "sub", "found.*", "found.named.*"
    )
    order_number = F.when(branch == "numbered", F.regexp_extract("item_title", L.AMENDMENT_ITEM, 1))
    return parsed.select(
        ID, "doc", "block_id", F.col("item").cast("bigint").alias("item"), F.col("sub").cast("bigint").alias("sub"),
        F.when(amended, "amendment").when(article, "article").when(appendix, "appendix")
        .when(branch == "section", "section").otherwise("unknown").alias("chunk_kind"),
        "title", "content",
        F.col("block.part_title").alias("part_title"),
        F.when(article, F.col("block.chapter_title")).alias("chapter_title"),
        F.when(article, F.col("block.section_title")).alias("section_title"),
        F.when(appendix, block_title).alias("appendix_title"),
        F.when(appendix, F.col("block.number")).alias("appendix_number"),
        F.when(article, block_title).alias("article_title"),
        F.when(article, F.col("block.number")).alias("article_number"),
        F.when(split, heading["level"]).alias("heading_level"),
        F.when(split, heading["number"]).alias("heading_number"),
        F.when(~amended, path).alias("section_path"),
        order_number.alias("order_number"),
        F.col("amendment.action").alias("action"),
        F.col("amendment.article").alias("target_article_number"),
        F.col("amendment.clause").alias("target_clause_text"),
        F.col("amendment.point").alias("target_point_text"),
    )


# --- small sections -----------------------------------------------------------

_ORDER = ["block_id", "item", "sub"]


def section_groups(chunks: Column, max_chars: int, min_chars: int) -> Column:
    """Greedy left-to-right grouping of one document's chunks; the group number per chunk.

    Only kinds, levels and lengths pass through the fold: merged text is
    left + blank line + title + newline + content.
    """
    start = F.struct(
        F.lit(0).alias("group"),
        F.lit(False).alias("section"),
        F.lit(0).alias("chars"),
        F.lit(None).cast("int").alias("level"),
        F.array().cast("array<int>").alias("out"),
    )

    def step(acc: Column, s: Column) -> Column:
        section = s["chunk_kind"] == "section"
        level, title, chars = s["heading_level"], F.length(s["title"]), F.length(s["content"])
        deeper = acc["level"].isNull() | level.isNull() | (level >= acc["level"])
        merge = (
            (acc["section"] & section & (F.coalesce(level, F.lit(0)) != 1) & deeper)
            & (acc["chars"] + chars + title + 2 <= max_chars)
            & (acc["chars"] < min_chars)
        )
        group = F.when(merge, acc["group"]).otherwise(acc["group"] + 1)
        gap = F.when(title > 0, title + 3).otherwise(F.lit(2))
        return F.struct(
            group.alias("group"),
            section.alias("section"),
            F.when(merge, acc["chars"] + gap + chars).otherwise(chars).alias("chars"),
            F.when(merge, acc["level"]).otherwise(level).alias("level"),
            F.concat(acc["out"], F.array(group)).alias("out"),
        )

    return F.aggregate(chunks, start, step, lambda acc: acc["out"])


def merge_small_sections(
    parsed: DataFrame, max_chars: int = L.MAX_CHUNK_CHARS, min_chars: int = L.MIN_SECTION_CHARS, keep_items: bool = False
) -> DataFrame:
    """Merge neighbouring section chunks while the left one is small; other chunks pass unchanged. With ``keep_items``
    each chunk lists in ``items`` the items that it was merged from.

    Every step is keyed by the document, so the chunks stay where the parser left them.
    """
    return _merged(parsed, max_chars, min_chars, keep_items).drop("chunk_index", "total_chunks")


def _merged(parsed: DataFrame, max_chars: int, min_chars: int, keep_items: bool) -> DataFrame:
    """The merged chunks with their chunk_index and total_chunks, which are their places in the document's array."""
    others = [c for c in parsed.columns if c not in (ID, *_ORDER)]
    # grouped in the aggregate: the filter that Spark adds below an explode would hold two copies of it
    members = F.array_sort(F.collect_list(F.struct(*_ORDER, *others)), _by_position)
    per_doc = parsed.groupBy(ID).agg(T.let(members, lambda s: _grouped_members(s, max_chars, min_chars)).alias("g"))
    merged = per_doc.select(
        ID, F.size("g").cast("bigint").alias("total_chunks"), F.posexplode("g").alias("chunk_index", "members")
    ).withColumn("head", F.col("members")[0])
    piece = lambda x, i: F.when(i == 0, x["content"]).otherwise(F.concat_ws("\n", F.nullif(x["title"], F.lit("")), x["content"]))
    joined = T.normalize_text(F.array_join(F.transform("members", piece), "\n\n"))
    paths = F.array_compact(F.transform("members", lambda x: x["section_path"]))
    kept = {
        "content": F.when(F.size("members") > 1, joined).otherwise(F.col("head.content")),
        "section_path": F.when(F.size("members") > 1, F.when(F.size(paths) > 0, F.array_join(paths, " > "))).otherwise(F.col("head.section_path")),
    }
    items = F.array_sort(F.array_distinct(F.transform("members", lambda x: x["item"])))
    return merged.select(
        ID,
        *[kept.get(c, F.col(f"head.{c}")).alias(c) for c in parsed.columns if c != ID],
        *([items.alias("items")] if keep_items else []),
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        "total_chunks",
    )


def _grouped_members(chunks: Column, max_chars: int, min_chars: int) -> Column:
    """The chunks of each group as an array; chunks of documents without sections are groups of one."""

    def cut(groups: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), groups)
        first = F.filter(F.transform(groups, lambda g, i: F.when(g != F.get(before, i), i + 1)), lambda at: at.isNotNull())
        return T.let(
            F.concat(first, F.array(F.size(groups) + 1)),
            lambda starts: F.transform(first, lambda at, k: F.slice(chunks, at, F.get(starts, k + 1) - at)),
        )

    alone = F.transform(chunks, lambda x: F.array(x))
    some = F.exists(chunks, lambda x: x["chunk_kind"] == "section")
    return F.when(some, T.let(section_groups(chunks, max_chars, min_chars), cut)).otherwise(alone)


def _by_position(left: Column, right: Column) -> Column:
    a, b = (F.struct(*[side[c] for c in _ORDER]) for side in (left, right))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def number_chunks(parsed: DataFrame) -> DataFrame:
    """chunk_index from 0 in reading order, and total_chunks, per document."""
    per_doc = Window.partitionBy(ID)
    return parsed.withColumn(
        "chunk_index", (F.row_number().over(per_doc.orderBy(*_ORDER)) - 1).cast("bigint")
    ).withColumn("total_chunks", F.count("*").over(per_doc))


# --- dispatcher -----------------------------------------------------------------


def parse_documents(
    docs: DataFrame,
    text: str = "text",
    carry: tuple[str, ...] = (),
    max_chars: int = L.MAX_CHUNK_CHARS,
    min_section_chars: int = L.MIN_SECTION_CHARS,
    prepared: bool = False,
    keep_items: bool = False,
) -> DataFrame:
    """Parsed, numbered chunks of every document: directory, major blocks, numbered headings, or one chunk. Texts that
    `prepare_text` has repaired before are marked by ``prepared``."""
    source = docs.select(ID, *carry, F.col(text).alias("text"))
    ready = F.col("text") if prepared else prepare_text(F.col("text"))
    directory = directory_chunks(source.filter(may_be_directory(F.col("text"))), ready, carry)
    lines = document_lines(source, ready, carry, skip_directories=True)
    parsed = parse_items(item_lines(block_lines(line_events(lines)), max_chars))
    merged = _merged(parsed, max_chars, min_section_chars, keep_items)
    return merged.unionByName(number_chunks(directory), allowMissingColumns=True)


def layout_lines(docs: DataFrame, text: str = "text", prepared: bool = False) -> DataFrame:
    """(doc_id, block_id, item, line): the lines whose page boxes belong to a chunk.

    The title and the lines of a block count for all its chunks (item is NULL). In documents without blocks block_id is 0:
    a heading item has its own lines, the first one also those before it; a text without headings is item 0; the chunk of
    a directory's unit, named by its first record, has the lines of its records.
    """
    source = docs.select(ID, F.col(text).alias("text"))
    ready = F.col("text") if prepared else prepare_text(F.col("text"))
    state = block_lines(line_events(document_lines(source, ready, skip_directories=True)))
    whole = Window.partitionBy(ID)
    headed = F.col("headings") > 0
    units = (
        state.withColumn("has_block", F.max("content").over(whole))
        .withColumn("heading", L.accepted_heading(F.col("line"), "roman", "numbered", "clause").isNotNull())
        .withColumn("headings", F.count(F.when(F.col("heading"), True)).over(whole))
        .withColumn("so_far", F.count(F.when(F.col("heading"), True)).over(_up_to()))
        .filter(F.col("line").isNotNull() & (~F.col("has_block") | F.col("opens") | F.col("content")))
        .select(
            ID,
            F.when(F.col("has_block"), F.col("block_id")).otherwise(0).cast("bigint").alias("block_id"),
            F.when(~F.col("has_block"), F.when(headed, F.greatest("so_far", F.lit(1))).otherwise(0)).cast("bigint").alias("item"),
            F.when(F.col("has_block") | ~headed, F.col("line")).otherwise(T.parser_line(F.col("line"))).alias("line"),
        )
    )
    directories = directory_lines(source.filter(may_be_directory(F.col("text"))), ready)
    return units.unionByName(directories).filter(F.col("line").isNotNull())
