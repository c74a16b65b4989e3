"""Toxicity by cumulative-link ordinal regression on sparse text features.

Labels say toxic or not. Toxic training texts get severity grades 1 to 3 by how densely they use terms that
mark toxic texts, clean ones grade 0. One weight vector serves all thresholds: P(grade > k) is the logistic
of w.x - t_k with ordered thresholds t_0 < t_1 < t_2, and the expected severity is the sum of the three.
Features are the words of a text and their beginnings, counted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .quality import labelled_sample

#: Labelled rows that a fit uses at most, terms considered at most, and terms kept.
FIT_ROWS = 20_000
CANDIDATES = 20_000
TERMS = 1500
#: Documents of the sample that must use a term.
LEAST_DOCS = 5
BEGINNINGS = (3, 4, 5, 6, 7)
GRADES = 3
#: Expected severity from which a document counts as toxic.
TOXIC_FROM = 0.4

_WORD = re.compile(r"[^\W\d_]+")


def term_counts(text: str | None) -> tuple[Counter, int]:
    """How often each term occurs in the whole text, and its number of words. ``^abc`` is a beginning."""
    words = Counter(_WORD.findall((text or "").lower()))
    terms: Counter = Counter()
    for w, n in words.items():
        terms[w] += n
        for k in BEGINNINGS:
            if len(w) > k:
                terms["^" + w[:k]] += n
    return terms, sum(words.values())


@dataclass
class OrdinalModel:
    """Weights by term, and the ordered thresholds."""

    weight: dict[str, float]
    thresholds: tuple[float, ...]

    def severity(self, text: str | None) -> tuple[float, int]:
        """(expected severity 0..GRADES, most likely grade) of one whole text."""
        words = Counter(_WORD.findall((text or "").lower()))
        found: Counter = Counter()
        weight = self.weight
        for w, n in words.items():
            if w in weight:
                found[w] += n
            for k in BEGINNINGS:
                if len(w) > k and (b := "^" + w[:k]) in weight:
                    found[b] += n
        total = sum(words.values())
        eta = sum(weight[t] * _value(t, n, total) for t, n in found.items())
        above = [1 / (1 + math.exp(min(60.0, max(-60.0, t - eta)))) for t in self.thresholds]
        steps = [1.0, *above, 0.0]
        chance = [a - b for a, b in zip(steps, steps[1:], strict=False)]
        return sum(above), max(range(len(chance)), key=lambda k: (chance[k], -k))


def _value(term: str, count: int, words: int) -> float:
    """Feature value: the beginning of a word counts for more in a short text, where chance brings it less often."""
    return math.log1p(count) * (min(1.0, math.sqrt(60 / (words + 20))) if term[0] == "^" else 1.0)


def fit_ordinal(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, grade: np.ndarray, n_terms: int, steps: int = 400, rate: float = 0.05, ridge: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the cumulative-link likelihood; the sparse matrix comes as triplets."""
    n = len(grade)
    k = np.arange(GRADES)
    above = (grade[:, None] > k[None, :]).astype(float)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    theta = -np.log(share / (1 - share))
    # thresholds as a first value and positive gaps, so that they stay ordered
    free = np.concatenate((np.zeros(n_terms), theta[:1], np.log(np.maximum(np.diff(theta), 0.1))))
    m, v = np.zeros(len(free)), np.zeros(len(free))
    for step in range(1, steps + 1):
        w, gaps = free[:n_terms], np.exp(free[n_terms + 1 :])
        theta = free[n_terms] + np.concatenate(([0.0], np.cumsum(gaps)))
        eta = np.bincount(rows, values * w[terms], n)
        slope = (1 / (1 + np.exp(np.clip(theta[None, :] - eta[:, None], -60, 60))) - above) / n  # each threshold's binary loss
        g_eta, g_theta = slope.sum(axis=1), -slope.sum(axis=0)
        grad = np.concatenate((np.bincount(terms, values * g_eta[rows], n_terms) + ridge * w / 10, [g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] * gaps))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        free = free - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return free[:n_terms], free[n_terms] + np.concatenate(([0.0], np.cumsum(np.exp(free[n_terms + 1 :]))))


def _log_odds(hits: np.ndarray, others: np.ndarray, n_hit: int, n_other: int) -> np.ndarray:
    p, q = (hits + 0.5) / (n_hit + 1), (others + 0.5) / (n_other + 1)
    return (np.log(p) - np.log(q)) / np.sqrt(1 / (hits + 0.5) + 1 / (others + 0.5))


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> OrdinalModel:
    """Learn from at most ``limit`` labelled documents; without both labels the model calls nothing toxic."""
    sample = cut_lineage(labelled_sample(docs, labels, "toxic", limit))

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(list(term_counts(text)[0]), pa.string())], names=["term"])

    often = sample.where("y > 0").mapInArrow(used, "term string").groupBy("term").count().where(F.col("count") >= LEAST_DOCS)
    often = often.orderBy(F.desc("count"), "term").limit(CANDIDATES).toPandas()
    candidates = set(often.term)
    sizes = {bool(r.toxic): r.n for r in sample.groupBy((F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if not candidates or len(sizes) < 2:
        return OrdinalModel({}, (30.0, 31.0, 32.0))

    def clean_use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                seen.update(candidates & term_counts(text)[0].keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    clean = sample.where("y = 0").mapInArrow(clean_use, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    table = often.merge(clean, on="term", how="left").fillna({"n": 0})
    z = _log_odds(table["count"].to_numpy(float), table.n.to_numpy(float), sizes[True], sizes[False])
    order = np.lexsort((table.term.to_numpy(), -np.abs(z)))[:TERMS]
    chosen = table.term.to_numpy()[order]
    strong = set(chosen[z[order] > 4])
    number = {t: i for i, t in enumerate(chosen)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, values, dense = [], [], []
            for text in b.column("text").to_pylist():
                counts, total = term_counts(text)
                own = sorted((number[t], _value(t, n, total)) for t, n in counts.items() if t in number)
                which.append([i for i, _ in own])
                values.append([v for _, v in own])
                dense.append(sum(n for t, n in counts.items() if t in strong and t[0] != "^") / max(1, total))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(which, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), pa.array(dense)], names=["doc_id", "y", "which", "value", "dense"])

    got = sample.withColumn("y", F.col("y").cast("long")).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(measure, "doc_id long, y long, which array<int>, value array<double>, dense double").toPandas()
    got = got.sort_values(["doc_id", "dense"], kind="stable").reset_index(drop=True)
    toxic = got.y.to_numpy() > 0
    cuts = np.quantile(got.dense[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, got.dense, side="left"), 0)
    sizes_of = got.which.map(len).to_numpy()
    weights, thresholds = fit_ordinal(np.repeat(np.arange(len(got)), sizes_of), np.concatenate(got.which.to_list()).astype(int), np.concatenate(got.value.to_list()), grade, len(chosen))
    return OrdinalModel({t: round(float(w), 6) for t, w in zip(chosen, weights, strict=True) if abs(w) > 1e-4}, tuple(round(float(t), 6) for t in thresholds))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id, expected_severity, grade, toxic`` for every row of ``docs``.

    ``expected_severity`` runs from 0 to GRADES; ``toxic`` marks TOXIC_FROM and more. Null and blank texts have
    no terms and get what the thresholds alone give, which is clean. Repeated rows are all returned; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [model.severity(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s for s, _ in made], pa.float64()), pa.array([g for _, g in made], pa.int32())], names=["doc_id", "expected_severity", "grade"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_severity double, grade int")
    return scored.withColumn("toxic", F.col("expected_severity") >= TOXIC_FROM)
