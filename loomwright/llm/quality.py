"""Quality classifier: a generalised additive model with pairwise interactions.

The model is a sum of lookup tables: one per text feature and one per chosen pair of features. Tables are
learned by cyclic boosting: round after round each feature in turn gets a shallow tree (at most two levels)
on the current logistic gradient, shrunk by a learning rate, and the trees of one feature add up to its
table. Pairs are ranked by what a two-way split gains on the residual and are boosted after the single
features. A score is then a few bin lookups and additions, done for whole batches at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, smallest_hashes

#: Labelled rows that a fit uses at most: those with the smallest hash of doc_id.
FIT_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_words", "word_length", "upper_share", "symbol_share", "marked_words", "exclamations", "pipes",
    "distinct_words", "top_word", "repeated_lines", "digit_share", "sentence_ends", "stutter", "short_words",
    "line_length", "high_bytes",
)

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SYMBOL = np.array([33 <= b <= 126 and not chr(b).isalnum() for b in range(256)])
_MARKS = tuple(bytes([b]) for b in b"#$%&*!|<>{}=+~^\\@")


def text_features(data: bytes | None) -> list[float]:
    """The values of FEATURES for one whole text; a null or blank text gives zeros."""
    words = (data or b"").split()
    if not words:
        return [0.0] * len(FEATURES)
    n, count = len(words), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, letters = len(data), count[_UPPER].sum() + count[_LOWER].sum()
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), size / n, count[_UPPER].sum() / max(1, letters), count[_SYMBOL].sum() / size,
        sum(w.endswith(_MARKS) for w in words) / n, count[33] / n, count[124] / n,
        len(seen) / n, max(seen.values()) / n, 1 - len(set(lines)) / len(lines), count[_DIGIT].sum() / size,
        sum(w.endswith((b".", b".\n")) for w in words) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(len(w) <= 3 for w in words) / n, float(np.log1p(n / len(lines))), count[128:].sum() / size,
    ]


@dataclass
class AdditiveModel:
    """Bin edges per feature, a table per feature, and a table per pair of features."""

    base: float
    edges: list[np.ndarray]
    single: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of feature values."""
        b = self.bins(x)
        total = self.base + sum(t[b[:, j]] for j, t in enumerate(self.single))
        for (i, j), t in self.pairs.items():
            total = total + t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_cut(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain and place of the best cut of each row of bins (the last axis)."""
    g, h = np.cumsum(grad, axis=-1), np.cumsum(hess, axis=-1)
    if g.shape[-1] < 2:
        return np.zeros(g.shape[:-1]), np.zeros(g.shape[:-1], dtype=int)
    all_g, all_h = g[..., -1:], h[..., -1:]
    gain = g[..., :-1] ** 2 / (h[..., :-1] + 1) + (all_g - g[..., :-1]) ** 2 / (all_h - h[..., :-1] + 1) - all_g**2 / (all_h + 1)
    at = np.argmax(gain, axis=-1)
    return np.take_along_axis(gain, at[..., None], -1)[..., 0], at + 1


def _tree(grad: np.ndarray, hess: np.ndarray, levels: int) -> np.ndarray:
    """Leaf value of each bin for a tree of so many levels."""
    gain, at = map(float, _best_cut(grad, hess)) if levels else (0.0, 0)
    at = int(at)
    if gain <= 1e-9:
        return np.full(len(grad), grad.sum() / (hess.sum() + 1))
    return np.concatenate([_tree(grad[:at], hess[:at], levels - 1), _tree(grad[at:], hess[at:], levels - 1)])


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 24, rounds: int = 120, rate: float = 0.15, pairs: int = 4, pair_rounds: int = 40) -> AdditiveModel:
    """Fit on feature rows ``x`` and labels 0/1 ``y``; without rows of both labels every score is the base rate."""
    p = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    model = AdditiveModel(float(np.log(p / (1 - p))), edges, [np.zeros(len(e) + 1) for e in edges])
    if not 0 < y.sum() < len(y):
        return model
    b = model.bins(x)
    f = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j, table in enumerate(model.single):
            grad, hess = slopes()
            step = rate * _tree(np.bincount(b[:, j], grad, len(table)), np.bincount(b[:, j], hess, len(table)), 2)
            table += step
            f += step[b[:, j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        grad, hess = slopes()
        shape = (len(model.single[i]), len(model.single[j]))
        cell = np.ravel_multi_index((b[:, i], b[:, j]), shape)
        return np.bincount(cell, grad, shape[0] * shape[1]).reshape(shape), np.bincount(cell, hess, shape[0] * shape[1]).reshape(shape)

    def pair_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
        """Cut the rows where the best column cuts of both halves gain most."""
        sides = [(np.cumsum(x, axis=0)[:-1], x.sum(axis=0) - np.cumsum(x, axis=0)[:-1]) for x in (grad, hess)]
        halves = [_best_cut(g, h)[0] + g.sum(axis=1) ** 2 / (h.sum(axis=1) + 1) for g, h in zip(*sides, strict=True)]
        gains = halves[0] + halves[1] - grad.sum() ** 2 / (hess.sum() + 1)
        at = int(np.argmax(gains)) + 1
        out = np.zeros(grad.shape)
        for rows in (slice(0, at), slice(at, None)):
            out[rows] = _tree(grad[rows].sum(axis=0), hess[rows].sum(axis=0), 1)
        return float(gains[at - 1]), out

    every = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1, len(FEATURES)) if len(edges[i]) and len(edges[j])]
    for i, j in sorted(every, key=lambda k: -pair_tree(*grid(*k))[0])[:pairs]:
        model.pairs[i, j] = np.zeros((len(model.single[i]), len(model.single[j])))
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            step = rate * pair_tree(*grid(i, j))[1]
            table += step
            f += step[b[:, i], b[:, j]]
    return model


def _crc(column: str, modulus: int):
    return F.crc32(F.col(column).cast("string")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = FIT_ROWS) -> DataFrame:
    """``doc_id, text, y`` of at most ``limit`` labelled documents, those with the smallest hash of doc_id.

    A document with several labels takes the largest, and of rows with equal doc_id the smallest text counts. The
    labels that join are at most ``limit`` rows of two numbers, so they are broadcast; only the sample is shuffled.
    """
    some = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    some = smallest_hashes(some, "doc_id", limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return rows.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("r")).select("doc_id", "r.*")


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> AdditiveModel:
    """Learn from labelled documents whose crc32(doc_id as text) mod 5 is not 0."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([text_features(x) for x in byte_values(b.column("text"))], pa.list_(pa.float64()))], names=["y", "x"])

    sample = labelled_sample(docs, labels.where(_crc("doc_id", 5) != 0), "quality", limit).select(F.col("y").cast("double").alias("y"), "text")
    got = sample.mapInArrow(measure, "y double, x array<double>").toPandas().sort_values("y", kind="stable")
    x = np.array(got.x.tolist(), dtype=float).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got.y.to_numpy()))  # so that a rerun sums in the same order
    return fit_additive(x[order], got.y.to_numpy(dtype=float)[order])


def score(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    ``held_out`` marks crc32(doc_id as text) mod 5 = 0 (null doc_id: false). Null and blank texts have all
    features zero and are scored like any other. Repeated rows are all returned; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(v) for v in byte_values(b.column("text"))], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(model.score(x))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(_crc("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score under ``threshold``; all columns stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(v) for v in byte_values(b.column(at))], dtype=float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
