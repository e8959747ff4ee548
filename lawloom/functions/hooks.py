"""Model hooks: embedder, pair scorer, generator. Each takes a plain Python factory; models load once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions.text import keyword_text, let

DEFAULT_DIM = 1024


def hashed_embedding(df: DataFrame, text: str, name: str = "embedding", dim: int = DEFAULT_DIM) -> DataFrame:
    """Deterministic default embedder: hashed word counts of the folded text, L2-normalised, on the JVM.

    Empty texts get an all-zero vector.
    """
    words = F.filter(F.split(keyword_text(F.col(text)), " "), lambda w: w != "")
    counted = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dim).transform(
        df.withColumn("__words", F.coalesce(words, F.array().cast("array<string>")))
    )
    unit = Normalizer(p=2.0, inputCol="__tf", outputCol="__unit").transform(counted)
    return unit.withColumn(name, vector_to_array("__unit", "float32")).drop("__words", "__tf", "__unit")


def embed(df: DataFrame, text: str, load: Callable | None = None, name: str = "embedding", dim: int = DEFAULT_DIM):
    """Vectors for a text column. ``load()`` returns a function from a list of texts to a list of vectors."""
    if load is None:
        return hashed_embedding(df, text, name, dim)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([_unit(v) for v in model(texts.fillna("").tolist())])

    def _unit(vector) -> list[float]:
        norm = sum(x * x for x in vector) ** 0.5
        return [float(x) / norm for x in vector] if norm else [float(x) for x in vector]

    return df.withColumn(name, F.pandas_udf(run, "array<float>")(F.col(text)))


def lexical_overlap(query: Column, text: Column) -> Column:
    """Deterministic default pair score: the share of distinct query words that the text contains."""
    words = lambda c: F.array_distinct(F.filter(F.split(keyword_text(c), " "), lambda w: w != ""))
    share = lambda q: F.size(F.array_intersect(q, words(text))) / F.nullif(F.size(q), F.lit(0))
    return F.coalesce(let(words(query), share), F.lit(0.0))


def pair_score(query: Column, text: Column, load: Callable | None = None) -> Column:
    """Score of (query, text) pairs. A model that fails, when it loads or when it scores, gives NULL for its batch."""
    if load is None:
        return lexical_overlap(query, text)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:
            model = None
        for queries, texts in batches:
            try:
                scores = model(list(zip(queries, texts)))
            except Exception:  # a missing model, or one that fails on a pair
                scores = [None] * len(queries)
            yield pd.Series(scores, dtype="float64")

    return F.pandas_udf(run, "double")(query, text)


def generate(df: DataFrame, prompt: str, load: Callable | None = None, fallback: str = "", name: str = "answer"):
    """Answers for a prompt column; a failing or empty generation gives the fallback text."""
    if load is None:
        return df.withColumn(name, F.concat(F.lit("[answer] "), F.col(prompt)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            yield prompts.map(lambda p: _one(model, p))

    def _one(model, p) -> str:
        try:
            return model(p) or fallback
        except Exception:
            return fallback

    return df.withColumn(name, F.pandas_udf(run, "string")(F.col(prompt)))
