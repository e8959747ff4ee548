"""Quality classifier by attention-based multiple-instance learning: a document is a bag of passages, only the document
has a label, and a gated attention learns which passages carry it.

Passages are lines, cut into runs of `PASSAGE_WORDS` words. Each is encoded by its own features through a tanh layer;
the attention weight of a passage is the softmax over its document of w . (tanh(V h) * sigmoid(U h)); the score is a
logistic function of the weighted sum of the passage encodings. Training (Adam on the log loss, in NumPy) uses at most
`SAMPLE_DOCS` labelled documents, taken in the order of a hash of their id, and at most `SAMPLE_PASSAGES` passages of
each; scoring reads every passage of every text.

Defined results: a null or wordless text is one empty passage; with labels of one class only, every score is that
class's share smoothed by one; rows are judged one by one, so repeated rows repeat; several labels of one document
count as their maximum, null labels not at all; extra columns are carried through and result columns replace those of
the same name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE_WORDS = 64
SAMPLE_DOCS, SAMPLE_PASSAGES = 4000, 64
HIDDEN, GATES = 16, 8
EPOCHS, BATCH_DOCS, RATE, DECAY, SEED = 60, 128, 0.01, 1e-4, 7
N_FEATURES = 15

_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SYMBOLS, _STOPS, _BANGS, _JOINTS = b"#*$%&|<>@^~_=+{}[]\\/", b".,;:", b"!?", b"-'\"()"
_BEYOND = bytes(range(128, 256))
_VOWELS = b"aeiouyAEIOUY"


def passages(text: str | None) -> list[list[bytes]]:
    """Words of each passage of the whole text."""
    out = []
    for line in (text or "").encode("utf-8", "replace").split(b"\n"):
        words = line.split()
        out.extend(words[i : i + PASSAGE_WORDS] for i in range(0, len(words), PASSAGE_WORDS))
    return out or [[]]


def encode(text: str | None) -> list[tuple[float, ...]]:
    """Features of every passage: length, characters by class, and repetition within the passage and in the document."""
    out, before = [], Counter()
    for words in passages(text):
        body = b"".join(words)
        n, size = len(words) or 1, len(body) or 1
        left = lambda chars: (size - len(body.translate(None, chars))) / size if body else 0.0  # noqa: E731, B023
        distinct = len(set(words)) / n
        pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
        before[body] += 1
        out.append((
            np.log1p(len(words)), size / n, left(_UPPER), left(_DIGITS), left(_SYMBOLS), left(_STOPS), left(_BANGS), left(_JOINTS),
            left(_BEYOND), left(_VOWELS), distinct, pairs, min(before[body] - 1, 5), max(map(len, words), default=0) / 20, float(not words),
        ))
    return out


@dataclass(frozen=True)
class BagModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of documents whose passages are the rows of x from each start on."""
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        return _forward((x - self.mean) / self.scale, starts, self.weights)["p"]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def _forward(x: np.ndarray, starts: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(x @ w["encode"] + w["encode_b"])
    t, g = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
    e = (t * g) @ w["attend"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
    a = e / np.add.reduceat(e, starts)[doc]
    z = np.add.reduceat(h * a[:, None], starts, axis=0)
    return {"doc": doc, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["out"] + w["out_b"])}


def _gradients(x: np.ndarray, starts: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    f = _forward(x, starts, w)
    doc, h, t, g, a = f["doc"], f["h"], f["t"], f["g"], f["a"]
    error = (f["p"] - y) / len(y)
    to_z = (error[:, None] * w["out"])[doc]
    to_a = (to_z * h).sum(axis=1)
    to_e = a * (to_a - np.add.reduceat(a * to_a, starts)[doc])
    mixed = to_e[:, None] * w["attend"]
    to_t, to_g = mixed * g * (1 - t * t), mixed * t * g * (1 - g)
    to_h = (a[:, None] * to_z + to_t @ w["tanh"].T + to_g @ w["gate"].T) * (1 - h * h)
    return {
        "encode": x.T @ to_h, "encode_b": to_h.sum(axis=0), "tanh": h.T @ to_t, "gate": h.T @ to_g,
        "attend": (t * g).T @ to_e, "out": f["z"].T @ error, "out_b": error.sum(keepdims=True),
    }


def fit(bags: list[np.ndarray], labels: np.ndarray) -> BagModel:
    """Train on bags of passage features (one array per document) and document labels 0 and 1."""
    one = float(labels.sum())
    if not 0 < one < len(labels):
        return BagModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, (one + 1) / (len(labels) + 2))
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-6
    rng = np.random.default_rng(SEED)
    start = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {
        "encode": start(N_FEATURES, HIDDEN), "encode_b": np.zeros(HIDDEN), "tanh": start(HIDDEN, GATES),
        "gate": start(HIDDEN, GATES), "attend": start(GATES), "out": start(HIDDEN), "out_b": np.zeros(1),
    }
    first, second, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    bags = [(b - mean) / scale for b in bags]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH_DOCS):
            chosen = order[i : i + BATCH_DOCS]
            part = [bags[j] for j in chosen]
            starts = np.concatenate(([0], np.cumsum([len(b) for b in part])[:-1]))
            step += 1
            for k, d in _gradients(np.concatenate(part), starts, labels[chosen], w).items():
                d = d + DECAY * w[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return BagModel(mean, scale, w)


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", doc_id: str = "doc_id",
                text: str = "text") -> BagModel:
    """Train on labelled documents for which `usable` (a condition on the label rows) holds."""
    chosen = (
        labels.filter(usable).filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("double")).alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
    )
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1):
                x = encode(t.as_py())
                found.append([[float(v) for v in row] for row in x[:: -(-len(x) // SAMPLE_PASSAGES)]])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["id", "y", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    sample = rows.select("id", "text", "y").mapInArrow(bags, f"id {kind}, y double, x array<array<double>>")
    got = sample.orderBy("id", "x").limit(2 * SAMPLE_DOCS).collect()
    return fit([np.array(r["x"]) for r in got], np.array([r["y"] for r in got], dtype=float))


def score_documents(docs: DataFrame, model: BagModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """All rows with score and predicted; of the input all columns, or those named in `carry`."""
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("score", "predicted")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, held, starts, size = [], [], [], 0
            for t in [*batch.column(1), None]:
                if held and (size > 20_000 or len(scores) + len(starts) == batch.num_rows):
                    scores.extend(model.score(np.array(held), np.array(starts)).tolist())
                    held, starts, size = [], [], 0
                if len(scores) + len(starts) < batch.num_rows:
                    x = encode(t.as_py())
                    starts.append(size)
                    held.extend(x)
                    size += len(x)
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    found = rows.mapInArrow(run, rows.select("row").schema.toDDL() + ", score double")
    return found.select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
