"""Column helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\u000b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the given tables, with the named columns only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once per row, also when `use` names it in lambdas."""
    return F.transform(F.array(value), use)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words between runs of ASCII white space; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
