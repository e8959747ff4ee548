"""Ordered per-key computations that stay balanced when one key holds a large share of the rows.

A window partitioned by a key puts the whole key into one task. Here the rows are dealt once by ranges of (key, whole
order) and written with the number of their range, so a hot key lies in many ranges of about equal size, ties included,
and the input is read for nothing else. Windows then run per (key, range). Only the first and the last key of a range
can go on in another range, so the summaries that carry counts and values from range to range are a few rows per range:
they are broadcast, and their number never grows with the rows or the keys. One plan serves all keys.

Rows with a null key or order come first, as windows sort them. The whole order must be unique where rows are numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawloom.session import materialize

_RANGE = "__bucket"


def _ranged(df: DataFrame, keys: list[str], order: list[str], max_rows: int | None) -> DataFrame:
    """The rows with the number of their range: as many ranges as the session's shuffles have partitions, or of about
    `max_rows` rows."""
    ranges = [max(1, -(-df.count() // max_rows))] if max_rows else []
    rows = df.repartitionByRange(*ranges, *keys, *order)
    return materialize(rows.withColumn(_RANGE, F.spark_partition_id()), "ranges")


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equal keys, nulls included; the names of the right side begin with two underscores."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[f"__{n}"])
    return out


def _shared_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that lie in more than one range, at most two per range."""
    ends = rows.groupBy(_RANGE).agg(F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi"))
    found = ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("k")).groupBy("k").count().filter("count > 1")
    return found.select(*[F.col("k")[n].alias(f"__{n}") for n in keys])


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    number: str | None = None,
    before: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Running values per key in one pass: the row's `number`, values of the row `before` it, and the `latest` non-null
    values at or before it."""
    before, latest = before or {}, latest or {}
    valued = df.select("*", *[F.struct(c.alias("v")).alias(f"__of_{n}") for n, c in before.items()],
                       *[c.alias(f"__of_{n}") for n, c in latest.items()])
    rows = _ranged(valued, keys, order, max_rows)
    at = F.struct(*order)

    shared = _shared_keys(rows, keys)
    parts = rows.join(F.broadcast(shared), _same(rows, shared, keys), "left_semi").groupBy(*keys, _RANGE).agg(
        F.count("*").alias("__n"),
        *[F.max_by(f"__of_{n}", at).alias(f"__of_{n}") for n in before],
        *[F.max_by(f"__of_{n}", F.when(F.col(f"__of_{n}").isNotNull(), at)).alias(f"__of_{n}") for n in latest],
    )
    ranges = Window.partitionBy(*keys).orderBy(_RANGE)
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        *[F.col(k).alias(f"__{k}") for k in [*keys, _RANGE]],
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"),
        *[F.lag(f"__of_{n}").over(ranges).alias(f"__carry_{n}") for n in before],
        *[F.last(f"__of_{n}", ignorenulls=True).over(earlier).alias(f"__carry_{n}") for n in latest],
    )

    local = Window.partitionBy(*keys, _RANGE).orderBy(*order)
    until = local.rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select(
        "*",
        *([F.row_number().over(local).alias("__number")] if number else []),
        *[F.lag(f"__of_{n}").over(local).alias(f"__here_{n}") for n in before],
        *[F.last(f"__of_{n}", ignorenulls=True).over(until).alias(f"__here_{n}") for n in latest],
    )
    joined = seen.join(F.broadcast(carried), _same(seen, carried, [*keys, _RANGE]), "left")
    value = lambda n: F.coalesce(joined[f"__here_{n}"], joined[f"__carry_{n}"])
    return joined.select(
        *[seen[c] for c in df.columns],
        *([(F.col("__number") + F.coalesce("__offset", F.lit(0))).cast("bigint").alias(number)] if number else []),
        *[value(n)["v"].alias(n) for n in before],
        *[value(n).alias(n) for n in latest],
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, max_rows: int | None = None) -> DataFrame:
    """row_number() per key."""
    return scan(df, keys, order, number=name, max_rows=max_rows)


def running_last(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, max_rows: int | None = None) -> DataFrame:
    """Last non-null ``value`` at or before each row: an as-of join of a table with itself."""
    return scan(df, keys, order, latest={name: value}, max_rows=max_rows)


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, max_rows: int | None = None) -> DataFrame:
    """``value`` of the row before each row of its key (lag 1)."""
    return scan(df, keys, order, before={name: value}, max_rows=max_rows)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: Column | int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark limits each map partition before the shuffle (WindowGroupLimit),
    so a hot key ships at most ``k`` rows per task; a per-row ``k`` needs a literal bound first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(w).cast("bigint"))
    return ranked.filter(F.col(name) <= k)
