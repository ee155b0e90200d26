"""Quality classifier: random-indexing word vectors, pooled per document, feed a two-layer numpy network
whose probabilities are calibrated by a temperature.

Every token has a sparse ternary index vector made from its hash. A token's vector adds up the index
vectors of its neighbours in the training sample. Tokens too rare there share the vector of their shape.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map
from .sampling import bounded_sample, fetch_texts
from .text import held_out

#: Bound of the training sample: documents of each label, and bytes of them together. Documents are taken whole.
DOCS, BYTES = 1500, 16_000_000
#: Width of vectors, non-zeros of an index vector, neighbours on each side, documents a word must occur in.
DIM, NONZERO, WINDOW, SEEN_IN = 128, 8, 2, 5
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
THRESHOLD = 0.3
MEMORY = 300_000

_tokens = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall


def shape(token: str) -> str:
    c = token[0]
    if c.isalpha():
        kind = "U" if len(token) > 1 and token.isupper() else "C" if c.isupper() else "l"
        return f"<{kind}{min(len(token) // 4, 5)}>"
    return "<d>" if c.isdigit() else f"<{token[:3]}>"


def key(token: str) -> str:
    """Words of capitals are known by shape alone, so that shouting is seen whatever is shouted."""
    return shape(token) if len(token) > 1 and token.isupper() or not token[0].isalpha() else token.lower()


def index_vector(name: str) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"), 11))
    v = np.zeros(DIM, np.float32)
    v[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return v


class _Rows(dict):
    """Token to row of the vector table; unknown tokens fall back to their shape, then to row 0."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        row = self.vocabulary.get(key(token))
        if row is None:
            row = self.vocabulary.get(shape(token), 0)
        if len(self) >= MEMORY:
            self.clear()
        self[token] = row
        return row


class Model:
    def __init__(self, vocabulary: dict[str, int], vectors: np.ndarray):
        self.vocabulary, self.vectors, self.rows = vocabulary, vectors, _Rows(vocabulary)
        self.repeat = vocabulary.get("<again>", 0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.rows = _Rows(self.vocabulary)

    def ids(self, text: str) -> np.ndarray:
        tokens = _tokens(text)
        return np.fromiter(map(self.rows.__getitem__, tokens), np.int32, len(tokens))

    def pooled(self, text: str | None) -> np.ndarray:
        """Mean vector, shares of repeated neighbours and log length; zeros for a text without tokens."""
        ids = self.ids(text or "")
        out = np.zeros(DIM + 3, np.float32)
        if len(ids):
            n = np.bincount(ids, minlength=len(self.vectors)).astype(np.float32)
            used = np.flatnonzero(n)
            out[:DIM] = (n[used] @ self.vectors[used]) / len(ids)
            out[DIM] = np.mean(ids[1:] == ids[:-1]) if len(ids) > 1 else 0
            out[DIM + 1] = len(used) / len(ids)
            out[DIM + 2] = np.log1p(len(ids)) / 10
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def word_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Vocabulary and vectors of a sample: own index vector plus the neighbours', each at unit length."""
    docs = [_tokens(t) for t in texts]
    seen = Counter(k for d in docs for k in {key(t) for t in d} | {shape(t) for t in d})
    names = ["<other>", *sorted(k for k, n in seen.items() if n >= SEEN_IN)]
    vocabulary = {k: i for i, k in enumerate(names)}
    rows, index = _Rows(vocabulary), np.stack([index_vector(k) for k in names])
    context = np.zeros_like(index)
    for d in docs:
        ids = np.fromiter(map(rows.__getitem__, d), np.int64, len(d))
        for step in range(1, WINDOW + 1):
            if len(ids) > step:
                np.add.at(context, ids[step:], index[ids[:-step]])
                np.add.at(context, ids[:-step], index[ids[step:]])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-6)
    return vocabulary, (unit(index) + unit(context)).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fits on four fifths of the sample and the temperature on the rest."""
    model = Model(*word_vectors(texts))
    x, y = np.stack([model.pooled(t) for t in texts]), np.array(labels, np.float32)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    tune, fit = order[: len(y) // 5], order[len(y) // 5 :]
    model.mean, model.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    params = {"w1": rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), "b2": np.zeros(1)}
    params = {k: v.astype(np.float32) for k, v in params.items()}
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in params.items()}
    z, share = (x - model.mean) / model.scale, np.clip(y[fit].mean(), 0.01, 0.99)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    step = 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            step += 1
            h = np.maximum(z[batch] @ params["w1"] + params["b1"], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params["w2"] + params["b2"], -30, 30)))
            g = (p - y[batch]) * weight[batch] / len(batch)
            gh = np.outer(g, params["w2"]) * (h > 0)
            for k, grad in {"w1": z[batch].T @ gh, "b1": gh.sum(0), "w2": h.T @ g, "b2": np.array([g.sum()])}.items():
                m, v = moment[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                params[k] -= RATE * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * params[k])
    model.__dict__ |= params
    tune = tune if len(tune) else fit
    raw, want = model.logits(x[tune]), y[tune]
    # classes were balanced for the fit; a shift brings the sample's own share back before calibration
    model.b2 = model.b2 + np.float32(np.log(share / (1 - share)))
    raw = raw + np.log(share / (1 - share))
    loss = lambda t: np.mean(np.logaddexp(0, raw / t) - want * raw / t)
    model.temperature = float(min(np.geomspace(0.25, 20, 60), key=loss))
    return model


def quality_scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text, ...); without a model the score is 0.5.
    Very long texts are pooled whole; other columns are ignored, whatever their names."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            s = model.scores(np.stack([model.pooled(t) for t in texts])).astype(np.float64) if model and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), score, "doc_id long, score double, predicted int")


def fit_quality(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model of a bounded sample of labelled rows: labels (doc_id, quality 0/1, ...) whose crc32 modulo 5
    isn't 0. The labels' own proportion is restored after the fit. A document with two labels counts for both.
    None if fewer than two labels occur."""
    rows = labels.where(~held_out(F.col("doc_id"), 5, 0) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    shares = {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}
    if len(shares) < 2:
        return None
    chosen = bounded_sample(rows, "quality", DOCS)
    got = fetch_texts(docs, chosen, BYTES)
    labels = [label for label, _, _ in got]
    if len(set(labels)) < 2:
        return None
    model = train([text for _, _, text in got], labels)
    sample = np.mean(labels)
    true = shares[1] / sum(shares.values())
    model.b2 = model.b2 + np.float32(model.temperature * (np.log(true / (1 - true)) - np.log(sample / (1 - sample))))
    return model


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. Null and empty texts get the score of a
    document without tokens; repeated rows are scored alike; an empty table gives no rows."""
    scored = quality_scores(docs, fit_quality(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
