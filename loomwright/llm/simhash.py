"""SimHash near-duplicate classes by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the XXH64 values of a document's word shingles. Two
fingerprints that differ in at most ``2 * half`` bits have a common variant at distance ``half`` or
less from both, and two that share such a variant differ in at most ``2 * half`` bits. So every
distinct fingerprint emits all its variants within ``half``, variants are shuffled, and those that
meet are links. Variants travel by their leading bits: a fingerprint is sent once for each leading
part its variants can have, and the receiving task writes out the remaining bits. That moves tens of
rows per fingerprint in place of thousands. A leading part that very many fingerprints share (a large
group of near copies) is cut further, so that group is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, connected_components, cut_lineage, keep_rows, text_keys

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Variants that a task holds at once.
CHUNK = 3_000_000


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text; zero when it has no word."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ones = np.zeros(64, dtype=np.int64)
    n = len(words) - shingle + 1
    for at in range(0, n, 65536):
        part = range(at, min(n, at + 65536))
        h = np.array([digest(joined[starts[i] : starts[i + shingle] - 1], SEED) for i in part], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, t1, t2, fp``, one row per row of ``docs``: hashes of the text, and a signed long with the fingerprint's bits."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in byte_values(b.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "t1", "t2")), pa.array(fps.view(np.int64))], names=["doc_id", "t1", "t2", "fp"])

    return text_keys(docs).mapInArrow(score, "doc_id long, t1 long, t2 long, fp long")


def flip_masks(low: int, high: int, most: int) -> list[np.ndarray]:
    """For each number of flips 0..most, the masks that flip so many of the bits low..high-1."""
    return [np.array([sum(1 << i for i in c) for c in combinations(range(low, high), n)], dtype=np.uint64) for n in range(most + 1)]


def spread(fp: np.ndarray, left: np.ndarray, have: int, want: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Flip bits between the leading ``have`` and ``want`` bits: (row index, value, flips left)."""
    for n, masks in enumerate(flip_masks(64 - want, 64 - have, int(left.max(initial=0)))):
        rows = np.flatnonzero(left >= n)
        if len(rows) and len(masks):
            yield np.repeat(rows, len(masks)), (fp[rows, None] ^ masks[None, :]).ravel(), np.repeat(left[rows] - n, len(masks))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (deeper := root[root] != root).any():
            root[deeper] = root[root[deeper]]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def meet(fp: np.ndarray, value: np.ndarray, left: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that tie each row to the first row it reaches over variants that meet; ``value`` has the first
    ``bits`` bits final."""
    size = sum(int((left >= n).sum()) * math.comb(64 - bits, n) for n in range(int(left.max(initial=0)) + 1))
    if size > CHUNK and bits < 60:
        deep = min(60, bits + 4)
        parts = [np.concatenate(x) for x in zip(*spread(value, left, bits, deep), strict=True)]
        key = parts[1] >> np.uint64(64 - deep)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        found = []
        for own in np.split(order, cuts):
            if len(own) > 1:
                rows = parts[0][own]
                x, y = meet(fp[rows], parts[1][own], parts[2][own], deep, radius)
                found.append((rows[x], rows[y]))
        a, b = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
    else:
        parts = list(spread(value, left, bits, 64))
        rows, variants = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(variants)
        variants, rows = variants[order], rows[order]
        same = variants[1:] == variants[:-1]
        a, b = rows[:-1][same], rows[1:][same]
        # the check of each colliding pair; the pairs of row and root above can be further apart
        a, b = a[ok := np.bitwise_count(fp[a] ^ fp[b]) <= radius], b[ok]
    root = local_roots(len(fp), a, b)
    other = np.flatnonzero(root != np.arange(len(fp)))
    return other, root[other]


def links(distinct: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Edges ``a, b`` whose components are those of the links at ``radius`` or fewer bits; ``distinct`` has ``fp, node``.

    Within a shared leading part each fingerprint is tied to the smallest node that its links reach there,
    so thousands of near copies give thousands of edges and not their square.
    """
    if radius % 2:
        raise ValueError("the radius must be even: both sides flip half of it")
    half = radius // 2
    bits = min(44, max(4, round(math.log2(max(1, count) / 800))))
    # Leading parts that more fingerprints share are cut further. There are at most 2**20 of them (8 MB), since each has
    # more than a 2**20th of all rows.
    usual = max(4096, 6 * count >> bits, count >> 20)
    parts = distinct.groupBy(F.shiftrightunsigned("fp", 64 - bits).alias("p")).count().where(F.col("count") > usual)
    shared = distinct.sparkSession.sparkContext.broadcast(np.sort(parts.select("p").toPandas()["p"].to_numpy().astype(np.uint64)))
    deep = min(56, bits + 16)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            node = b.column("node").to_numpy()
            for rows, value, left in spread(fp, np.full(len(fp), half), 0, bits):
                key = value >> np.uint64(64 - bits)
                is_hot = np.isin(key, hot)
                outs = [(rows[~is_hot], key[~is_hot] * np.uint64(64) + np.uint64(bits), value[~is_hot], left[~is_hot])]
                if is_hot.any():
                    own = rows[is_hot]
                    for r2, v2, l2 in spread(value[is_hot], left[is_hot], bits, deep):
                        outs.append((own[r2], (v2 >> np.uint64(64 - deep)) * np.uint64(64) + np.uint64(deep), v2, l2))
                for r, k, v, m in outs:
                    for at in range(0, len(r), 100_000):
                        s = slice(at, at + 100_000)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[s].view(np.int64), fp[r[s]].view(np.int64), v[s].view(np.int64), node[r[s]], m[s].astype(np.int8))], names=["part", "fp", "value", "node", "left"])

    def collide(group: pa.Table) -> pa.Table:
        fp, value = (group[c].to_numpy().view(np.uint64) for c in ("fp", "value"))
        node = group["node"].to_numpy()
        order = np.argsort(node)  # so that the local root is the smallest node
        bits = int(group["part"][0].as_py()) & 63
        a, b = meet(fp[order], value[order], group["left"].to_numpy()[order].astype(np.int64), bits, radius)
        return pa.table({"a": node[order][a], "b": node[order][b]})

    sent = distinct.select("fp", "node").mapInArrow(emit, "part long, fp long, value long, node long, left byte")
    return sent.groupBy("part").applyInArrow(collide, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest doc_id reachable over
    links of ``radius`` or fewer differing bits. A null or blank text has fingerprint zero and links like
    any other. A row without doc_id keeps its fingerprint, links nothing and has a null component. Repeated
    rows come back as often as they are given; an empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    edges = links(distinct, distinct.count(), radius)
    comp = connected_components(edges)
    classes = distinct.join(comp, "node", "left").select(F.col("fp").alias("k"), F.coalesce("component", "node").alias("c"))
    return prints.join(classes, prints.fp == classes.k, "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"),
    )


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each near-duplicate class of ``docs``, as ``similar.keep_one`` takes it; rows without doc_id link nothing
    and stay. All columns stay."""
    prints = cut_lineage(fingerprints(docs, shingle))
    distinct = prints.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("first"))
    distinct = cut_lineage(distinct.withColumn("node", F.col("fp")))
    return keep_rows(docs, prints, distinct, connected_components(links(distinct, distinct.count(), radius)))
