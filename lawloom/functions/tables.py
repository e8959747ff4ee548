"""HTML tables to pipe tables, as expressions over the text of one cell.

A table is an array of rows of cells. One fold over the rows places the cells in a grid; its state is the list of cells
that reach down into the next row. Spans are bounded as browsers bound them: 1,000 columns and 65,534 rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lawloom.functions.text import collapse, let, visible_text

MAX_COLUMNS, MAX_ROWS = 1000, 65_534
_TABLE = r"(?is)(<table\b.*?</table>)"
_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
_OPEN, _CLOSE = "\u0001", "\u0002"
_WAITING = "array<struct<left:int,text:string>>"


def _span(attributes: Column, name: str, most: int) -> Column:
    """A span attribute; 1 where it is missing, zero or no number."""
    digits = F.regexp_extract(attributes, rf"""(?i)(?:^|[\s"'/]){name}\s*=\s*["']?\s*0*(\d+)\s*(?:["'\s/]|$)""", 1)
    value = F.when(F.length(digits) > 6, F.lit(most)).otherwise(F.greatest(digits.try_cast("int"), F.lit(1)))
    return F.least(F.coalesce(value, F.lit(1)), F.lit(most))


def _cell(piece: Column) -> Column:
    """struct(text, across, down) of what follows the name of a cell's tag."""
    attributes = F.regexp_extract(piece, rf"(?s)\A({_ATTRIBUTES})>", 1)
    inside = F.regexp_extract(piece, rf"(?is)\A{_ATTRIBUTES}>(.*?)(?:</t[dhr]\b.*)?\z", 1)
    return F.struct(
        F.replace(collapse(visible_text(inside)), F.lit("|"), F.lit("\\|")).alias("text"),
        _span(attributes, "colspan", MAX_COLUMNS).alias("across"),
        _span(attributes, "rowspan", MAX_ROWS).alias("down"),
    )


def _after(pieces: Column) -> Column:
    """All pieces but the first."""
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


def table_cells(markup: Column) -> Column:
    """Rows of struct(text, across, down)."""
    shown = F.regexp_replace(markup, r"(?s)<!--.*?-->", "")
    rows = _after(F.split(shown, r"(?i)<tr(?=[\s/>])"))
    return F.transform(rows, lambda row: F.transform(_after(F.split(row, r"(?i)<t[dh](?=[\s/>])")), _cell))


def _line_of(texts: Column, waiting: Column) -> Column:
    return F.struct(texts.cast("array<string>").alias("texts"), waiting.cast(_WAITING).alias("waiting"))


def _inherited(line: Column, above: Column) -> Column:
    """The line with the cells from above that follow without a gap."""

    def joined(rest: Column) -> Column:
        gap = F.array_position(F.transform(rest, lambda x: x.isNull()), F.lit(True)).cast("int")
        run = F.slice(rest, F.lit(1), F.when(gap > 0, gap - 1).otherwise(F.size(rest)))
        lower = F.transform(run, lambda x: F.when(x["left"] > 1, F.struct((x["left"] - 1).alias("left"), x["text"].alias("text"))))
        return _line_of(F.concat(line["texts"], F.transform(run, lambda x: x["text"])), F.concat(line["waiting"], lower.cast(_WAITING)))

    done = F.size(line["texts"])
    return let(F.slice(above, done + 1, F.greatest(F.size(above) - done, F.lit(0))), joined)


def _placed(line: Column, cell: Column) -> Column:
    """The line with one more cell: its text, then blanks to its right; below it all of them repeat."""

    def joined(texts: Column) -> Column:
        lower = F.transform(texts, lambda t: F.when(cell["down"] > 1, F.struct((cell["down"] - 1).alias("left"), t.alias("text"))))
        return _line_of(F.concat(line["texts"], texts), F.concat(line["waiting"], lower.cast(_WAITING)))

    return let(F.concat(F.array(cell["text"]), F.array_repeat(F.lit(""), cell["across"] - 1)), joined)


def table_grid(rows: Column) -> Column:
    """Rectangular grid of texts: a spanned cell repeats downwards, and leaves blanks to its right."""
    none = F.array()

    def line(cells: Column, above: Column) -> Column:
        step = lambda acc, cell: let(_inherited(acc, above), lambda x: _placed(x, cell))
        return F.aggregate(cells, _line_of(none, none), step, lambda acc: _inherited(acc, above))

    start = F.struct(none.cast("array<array<string>>").alias("grid"), none.cast(_WAITING).alias("waiting"))

    def add(acc: Column, cells: Column) -> Column:
        return let(
            line(cells, acc["waiting"]),
            lambda x: F.struct(F.concat(acc["grid"], F.array(x["texts"])).alias("grid"), x["waiting"].alias("waiting")),
        )

    def squared(grid: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))
        return F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))

    return let(F.aggregate(rows, start, add, lambda acc: acc["grid"]), squared)


def _pipes(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table_markdown(markup: Column) -> Column:
    """Pipe table whose header is the first two rows in one; markup without rows stays as it is."""

    def header(grid: Column) -> Column:
        def both(upper: Column, lower: Column) -> Column:
            parts = F.array_distinct(F.filter(F.array(upper, lower), lambda x: x != ""))
            return F.array_join(parts, " - ")

        return F.zip_with(grid[0], F.coalesce(F.get(grid, F.lit(1)), F.transform(grid[0], lambda _: F.lit(""))), both)

    def drawn(grid: Column) -> Column:
        rule = F.transform(grid[0], lambda _: F.lit("---"))
        lines = F.concat(F.array(_pipes(header(grid)), _pipes(rule)), F.transform(F.slice(grid, F.lit(3), F.greatest(F.size(grid) - 2, F.lit(0))), _pipes))
        return F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))

    return let(table_grid(table_cells(markup)), lambda grid: F.when(F.size(grid) > 0, drawn(grid)).otherwise(markup))


def html_tables_to_markdown(c: Column) -> Column:
    marked = F.regexp_replace(c, _TABLE, f"{_OPEN}$1{_CLOSE}")
    pieces = F.transform(F.split(marked, f"[{_OPEN}{_CLOSE}]"), lambda x, i: F.when(i % 2 == 1, table_markdown(x)).otherwise(x))
    return F.when(F.contains(c, F.lit("<")) & c.rlike(r"(?i)<table\b"), F.array_join(pieces, "")).otherwise(c)
