"""Resampling towards a target distribution, by hashed word runs and Gumbel keys.

One scan of a document keeps a ring of running zlib states, one for each of the last n word starts: a new word extends
each of them by a space and itself and starts one more, and every state after a word is the code of the run that ends
there. Codes modulo the number of buckets are the features. A bucket's gain is the logarithm of how much likelier
it is in the target texts; documents with the largest sum of gains plus Gumbel noise are drawn, which samples without
replacement in proportion to their importance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import byte_values, written

BUCKETS = 10_000
RUN_WORDS = 1
SEED = 2024
#: Words that a document needs to be drawn, and how many of a hundred such documents are.
LEAST_WORDS, PERCENT = 20, 10
#: Digits, lower-case letters and all bytes from 0x80 stay; capital letters become lower case; the rest are spaces.
_FOLD = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def run_codes(some: list[bytes], longest: int = RUN_WORDS) -> list[int]:
    """CRC-32 of every run of 1 to ``longest`` consecutive words, joined by one space."""
    if longest == 1:  # the ring has one place, which every word starts anew
        return list(map(crc32, some))
    ring: list[int] = []
    out: list[int] = []
    for word in some:
        ring = [crc32(word, crc32(b" ", state)) for state in ring]
        ring.append(crc32(word))
        out += ring
        if len(ring) == longest:
            del ring[0]
    return out


def _buckets(text: bytes | None, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    some = words(text)
    return len(some), np.array(run_codes(some, longest), dtype=np.int64) % buckets


def bucket_counts(texts: DataFrame, longest: int = RUN_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` of all texts: each task adds up its own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for text in byte_values(b.column("text")):
                total += np.bincount(_buckets(text, longest, buckets)[1], minlength=buckets) if text else 0
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["bucket", "n"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = RUN_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths, from all texts of both tables. The driver gets one number a bucket and table."""
    raw, aim = np.zeros(buckets, dtype=object), np.zeros(buckets, dtype=object)
    for counts, table in ((raw, docs), (aim, target)):
        for r in bucket_counts(table, longest, buckets).collect():
            counts[r.bucket] = r.n
    of_raw, of_aim = float(sum(raw) + buckets), float(sum(aim) + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * of_raw / ((s + 1) * of_aim))) for s, t in zip(raw, aim, strict=True)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = RUN_WORDS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.zeros((3, b.num_rows), dtype=np.int64)
            for i, text in enumerate(byte_values(b.column("text"))):
                if text:
                    n, own = _buckets(text, longest, len(gain))
                    made[:, i] = n, len(own), gain[own].sum()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, made)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = RUN_WORDS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``; ``rank`` is null where it isn't drawn.

    The score adds Gumbel noise, which a document's id and the seed fix, to its weight. Of N documents with at least
    ``least_words`` words, floor(N * percent / 100) with the largest scores are drawn, ties to the smaller doc_id. Null and
    blank texts have no features and weight 0. Rows without doc_id share one noise, that of an empty id, and
    are behind others of the same score; repeated rows are ranked each, in any order. An empty table gives an empty
    result; with an empty target all gains say only what is rare in ``docs``. Counts are of all rows; two passes read the texts.
    """
    scored = weights(docs, gains(docs, target, longest, buckets), longest)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # the last column of the order tells repeated rows apart, so that they too are dealt to many tasks
    scored = written(scored.withColumn("score", F.col("weight") + noise).withColumn("_row", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    place = numbered(able, F.desc("score"), F.asc_nulls_last("doc_id"), F.xxhash64("_row"), name="_place")
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1).cast("long")
    out = place.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
    return out.unionByName(scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; doc_id must be unique here."""
    kept = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn"))
    return docs.join(kept, docs["doc_id"].cast("long") == kept["_drawn"], "left_semi")
