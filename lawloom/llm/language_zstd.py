"""Language identification by compression: a text is compressed with a raw-content dictionary of each language, and the
language whose dictionary gives the fewest bytes wins.

A dictionary is up to `DICTIONARY_BYTES` of training texts of its language, taken in the order of a hash of the text, so
it does not depend on partitions nor on how often a text is repeated. This bounded sample (`SAMPLE_TEXTS` distinct texts
per language, or all where a language has fewer) is all that the fit reads into the driver. Texts are reduced to lower-case letters and single spaces and compressed whole, in pieces
of `PIECE` bytes, so that a long text cannot serve as its own dictionary.

Equal sizes go to the language with more training documents, then to the first by name. `accepted` is false where the
runner-up is within `MARGIN` of the smallest size. Defined results: a null text or one without a letter is `und` with
score 0 and not accepted; with no labelled text every text is `und`; rows are judged one by one, so repeated rows repeat;
extra columns are carried through and result columns replace those of the same name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DICTIONARY_BYTES = 64 << 10
SAMPLE_TEXTS = 64
SAMPLE_CHARS = 8_000  # longer texts are not used for dictionaries unless a language has no other
PIECE = 1000
LEVEL, MIN_MATCH = 6, 3
MARGIN = 0.01
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    """Dictionary content and share of the training documents by language."""

    dictionaries: dict[str, bytes]
    shares: dict[str, float]


def letters(text: str | None) -> bytes:
    """Lower-case letters with single spaces between words; empty without a letter."""
    plain = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {plain} ".encode("utf-8", "replace") if plain else b""


def fit_languages(rows: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from rows with a text and a language. Shares count all of them; dictionaries take a bounded sample."""
    rows = rows.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("d")).collect()
    counts = {r["lang"]: r["n"] for r in found}
    # A share of each language's hashes, enough for the sample eight times over, so that few texts are sorted. It goes by
    # distinct texts: copies have one hash, so a share by rows would leave too few texts of a language of many copies.
    low = [(F.col("lang") == r["lang"]) & (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) <= (SAMPLE_TEXTS << 23) // max(1, r["d"])) for r in found]
    near = rows.filter(reduce(lambda x, y: x | y, low)) if low else rows
    first = Window.partitionBy("lang").orderBy(F.length("text") > SAMPLE_CHARS, F.xxhash64("text"), "text")
    near = near.distinct().withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= SAMPLE_TEXTS)
    sample = near.orderBy("lang", "rank").select("lang", "rank", "text").collect()
    dictionaries: dict[str, bytes] = {}
    for name, _, t in sample:
        dictionaries[name] = (dictionaries.get(name, b"") + letters(t))[:DICTIONARY_BYTES]
    total = sum(counts.values()) or 1
    return LanguageModel({k: v for k, v in dictionaries.items() if v}, {k: n / total for k, n in counts.items()})


class Sizer:
    """Compressors of a model; sizes of one text by language."""

    def __init__(self, model: LanguageModel):
        self.names = sorted(model.dictionaries, key=lambda k: (-model.shares[k], k))
        self.compressors = []
        for name in self.names:
            content = model.dictionaries[name]
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(content), source_size=PIECE, min_match=MIN_MATCH, write_content_size=False
            )
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=params)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=params))

    def sizes(self, plain: bytes) -> list[int]:
        pieces = [plain[i : i + PIECE] for i in range(0, len(plain), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (how much the smallest size stands out) and whether the margin is wide enough."""
        plain = letters(text)
        if not plain or not self.names:
            return "und", 0.0, False
        sizes = self.sizes(plain)
        best = min(sizes)
        score = 1 / sum(math.exp(-(s - best) / max(2.0, 0.02 * best)) for s in sizes)
        runner_up = sorted(sizes)[1] if len(sizes) > 1 else math.inf
        return self.names[sizes.index(best)], score, runner_up >= best * (1 + MARGIN)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """All rows with lang_pred, score and accepted; of the input all columns, or those named in `carry`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("lang_pred", "score", "accepted")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(shared.value)
        for batch in batches:
            out = [sizer.judge(t.as_py()) for t in batch.column(1)]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.record_batch([batch.column(0), *columns], names=["row", "lang_pred", "score", "accepted"])

    kinds = (pa.string(), pa.float64(), pa.bool_())
    schema = rows.select("row").schema.toDDL() + ", lang_pred string, score double, accepted boolean"
    return rows.mapInArrow(judge, schema).select("row.*", "lang_pred", "score", "accepted")
