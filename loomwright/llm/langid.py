"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds (multiplies) its letters'
vectors, each permuted (rolled) by its place in the n-gram; a text's vector bundles (adds) the vectors of
its n-grams; a language's prototype bundles those of its training texts, each scaled to length one. A text
gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, smallest_hashes

DIMENSIONS = 1024
GRAM = 3
#: Training documents at most: those with the smallest hash of doc_id.
FIT_ROWS = 20_000
#: Letters have a vector each up to this code point; those above share vectors by code point.
OWN_LETTERS, SHARED_LETTERS = 0x250, 431
UNKNOWN = "und"
_BATCH_LETTERS = 400_000


@cache
def letter_index() -> np.ndarray:
    """Row of each code point in the letter table; row 0 stands for whatever is no letter."""
    table = np.zeros(0x110000, dtype=np.uint16)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            low = chr(cp).lower()
            cp2 = ord(low) if len(low) == 1 else cp
            table[cp] = cp2 if cp2 < OWN_LETTERS else OWN_LETTERS + cp2 % SHARED_LETTERS
    return table


@cache
def letter_vectors(dimensions: int) -> np.ndarray:
    """One row of +1 and -1 for each letter; fixed by the seed."""
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.choice(np.array([-1, 1], dtype=np.int8), (OWN_LETTERS + SHARED_LETTERS, dimensions))


def gram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS, gram: int = GRAM) -> np.ndarray:
    """Bound vectors of n-grams, given as letter rows in base 1024."""
    vectors = letter_vectors(dimensions)
    out = None
    for place in range(gram):
        letters = np.roll(vectors, place, axis=1)[grams >> (10 * (gram - 1 - place)) & 1023]
        out = letters if out is None else out * letters
    return out


def _letters(data: bytes | None) -> np.ndarray:
    """Letter rows of a text with one 0 between words, at its start and at its end."""
    text = unicodedata.normalize("NFC", (data or b"").decode("utf-8", "replace"))
    row = letter_index()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    row = np.concatenate(([0], row, [0]))
    return row[np.concatenate(([True], (row[1:] != 0) | (row[:-1] != 0)))]


def text_vectors(texts: list[bytes | None], dimensions: int = DIMENSIONS, gram: int = GRAM) -> np.ndarray:
    """Bundled vectors (rows, float32), of the whole texts; zero for a text without letters."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    rows = [_letters(x).astype(np.int64) for x in texts]
    at = 0
    while at < len(rows):
        stop, total = at, 0
        while stop < len(rows) and (stop == at or total + len(rows[stop]) <= _BATCH_LETTERS) and stop - at < 128:
            total += len(rows[stop])
            stop += 1
        codes, owner = [], []
        for i in range(at, stop):
            r = rows[i]
            if len(r) >= gram and r.any():
                codes.append(sum(r[p : len(r) - gram + 1 + p] << (10 * (gram - 1 - p)) for p in range(gram)))
                owner.append(np.full(len(codes[-1]), i - at))
        if codes:
            distinct, which = np.unique(np.concatenate(codes), return_inverse=True)
            counts = np.bincount(np.concatenate(owner) * len(distinct) + which, minlength=(stop - at) * len(distinct))
            counts = counts.reshape(stop - at, len(distinct)).astype(np.float32)
            for g in range(0, len(distinct), 8192):
                out[at:stop] += counts[:, g : g + 8192] @ gram_vectors(distinct[g : g + 8192], dimensions, gram).astype(np.float32)
        at = stop
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, limit: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (rows of length one).

    Learns from text and lang of at most ``limit`` documents with non-null lang whose crc32(doc_id as text)
    mod 3 is not 1. The tasks add up their documents' vectors; the driver gets a few vectors a task.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    some = smallest_hashes(own.select(F.col("doc_id").alias("chosen")), "chosen", limit).distinct()
    sample = own.select("doc_id", "text", "lang").join(F.broadcast(some), F.col("doc_id") == F.col("chosen"), "left_semi")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                made, langs = unit(text_vectors(byte_values(part.column("text")))), np.array(part.column("lang").to_pylist())
                for lang in set(langs.tolist()):
                    total[lang] = total.get(lang, 0) + made[langs == lang].sum(axis=0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()])], names=["lang", "total"])

    sums: dict[str, np.ndarray] = {}
    parts = sample.select("text", "lang").mapInArrow(bundle, "lang string, total array<double>").toPandas()
    for lang, v in zip(parts.lang, parts.total, strict=True):
        sums[lang] = sums.get(lang, 0) + np.asarray(v)
    langs = sorted(sums)
    return langs, unit(np.array([sums[x] for x in langs]).reshape(len(langs), DIMENSIONS)).round(6).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    ``score`` is the largest cosine, not below 0. A null text, one without any letter, and any text when no
    language was learned get ``und`` and 0. ``held_out`` marks crc32(doc_id as text) mod 3 = 1 (null doc_id:
    false). Equal cosines go to the language that sorts first. Repeated rows are all returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = [], []
            for at in range(0, b.num_rows, 128):
                made = text_vectors(byte_values(b.column("text").slice(at, 128)))
                known = np.abs(made).max(axis=1) > 0
                cosine = unit(made) @ prototypes.T if langs else np.zeros((len(made), 1))
                best = np.argmax(cosine.round(6), axis=1)
                top = np.clip(cosine[np.arange(len(made)), best], 0, 1).astype(float)
                names += [langs[k] if ok and langs else UNKNOWN for k, ok in zip(best, known, strict=True)]
                scores.append(np.where(known & bool(langs), top, 0.0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
