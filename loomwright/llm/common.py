"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import cut_lineage as cut_lineage
from ..operators.ordering import written as written

# 64-bit finaliser constants of the public SplitMix64 generator (fixed values).
_MIX_ADD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of each element (uint64 in, uint64 out)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + _MIX_ADD
        z = (z ^ (z >> np.uint64(30))) * _MIX_A
        z = (z ^ (z >> np.uint64(27))) * _MIX_B
        return z ^ (z >> np.uint64(31))


def byte_values(column: pa.Array) -> list[bytes | None]:
    """Values of a string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as ``a, b`` (long) rows.

    Returns ``node, component`` for every node of an edge; ``component`` is the smallest node
    reachable. Alternates large-star and small-star rounds (Kiveris et al., "Connected Components
    in MapReduce and Beyond", 2014) until the edge set is stable. No neighbourhood is ever
    gathered: each round is a grouped minimum and an equi-join, which adaptive execution can
    split when a hub holds many of the rows.
    """
    edges = cut_lineage(edges.where("a is not null and b is not null and a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a > b in every row now, so the lower neighbours of a are exactly its rows
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, large.a == low.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.where("a <> b").union(low.select("u", "m")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def smallest_hashes(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest hash of ``key``. Of many rows, those with hashes too large to be among them are
    left out before they are sorted, so that the last sort is of little more than ``limit`` rows."""
    count = rows.count()
    if count > 4 * limit:
        rows = rows.where(F.xxhash64(key) <= int(2**64 * (limit + 10 * limit**0.5 + 100) / count) - 2**63)
    return rows.orderBy(F.xxhash64(key), key).limit(limit)


def text_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, text, t1, t2``: each row with 128 bits of hashes of its text."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("t1"), F.xxhash64(F.lit(1), docs["text"]).alias("t2"))


def keep_rows(docs: DataFrame, keys: DataFrame, distinct: DataFrame, components: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, and all rows without doc_id; all columns stay.

    ``keys`` has ``doc_id, t1, t2`` of every row, ``distinct`` the ``node`` and its ``first`` such key, ``components``
    the ``component`` of each linked node. Of rows that agree in doc_id and text one stays.
    """
    best = distinct.join(components, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("k"))
    # only keys that several rows share need their rows gathered
    times = keys.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("times"))
    kept = cut_lineage(best.select("k.*").join(times, ["doc_id", "t1", "t2"]).select(F.col("doc_id").alias("kept_id"), F.col("t1").alias("kept_1"), F.col("t2").alias("kept_2"), "times"))
    ident, first, second = docs["doc_id"].cast("long"), F.xxhash64(docs["text"]), F.xxhash64(F.lit(1), docs["text"])
    match = lambda k: (ident == k["kept_id"]) & (first == k["kept_1"]) & (second == k["kept_2"])
    once, often = kept.where("times = 1"), kept.where("times > 1")
    rows = docs.join(once, match(once), "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))
    if often.isEmpty():
        return rows
    columns = [docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]
    again = docs.join(often, match(often), "left_semi")
    again = again.groupBy(ident, first, second).agg(F.min_by(F.struct(*columns), F.xxhash64(F.to_json(F.struct(*columns)))).alias("row"))
    return rows.unionByName(again.select(*(F.col("row")[c].alias(c) for c in docs.columns)))
