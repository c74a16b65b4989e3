"""Near-duplicate classes at a given shingle similarity, by SimHash ball hashing over several tables.

One 64-bit fingerprint with a radius of 4 bits holds copies that differ in few words. A Jaccard similarity of
0.8 leaves about 15 % of all bits different, ten of 64, and a ball of half that radius cannot be written out.
So a document gets a long fingerprint, which is cut into tables of a few dozen bits each. In each table every
fingerprint emits all variants within two bits, as in ``simhash``, and those that meet, at four differing bits
or fewer, are candidates; enough tables reach the target recall. A candidate pair is verified on separate bits
of the long fingerprint, whose share of differing bits measures the similarity.

Fingerprints travel by blocks of a table's bits: of five blocks, one is equal in any two fingerprints that differ
in four bits, so each fingerprint is sent once for each block, however many documents there are, and the task that
gets a block's value writes out the ball over all other bits. Where blocks of a fifth of the bits are too few values
for the number of documents, two longer blocks take their place, each sent with one bit flipped as well. Both
routings find the same pairs.

A block's value that very many fingerprints share, such as that of a large family of near copies, is dealt to tiles of
bounded size, which tie the family together; then the fingerprints that are not of its largest class there visit
every tile, so that no pair is missed and no task holds the family.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, connected_components, cut_lineage, keep_rows, mix64, text_keys
from .simhash import SEED, flip_masks, local_roots

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.97
HALF = 2
#: 64-bit words of the fingerprint that verify a pair.
CHECK_WORDS = 8
#: Fingerprints of a block's value: as aimed at, and at most before longer blocks are taken; and variants that a
#: task holds at once.
PART_ROWS = 25_000
MOST_PART_ROWS = 400_000
CHUNK = 3_000_000
#: Fingerprints of a block's value from which it is dealt to tiles, and of a tile.
HOT_ROWS, TILE_ROWS = 100_000, 50_000
#: Rows and columns of the pairs that a task compares at once.
TILE = (256, 8192)
#: Standard errors above the expected differing check bits at which a pair still counts.
SLACK = 1.7


def differing_share(similarity: float) -> float:
    """Share of differing bits at a Jaccard similarity: the angle between two sets of which it is true."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(count: int, similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a table, number of tables): bits grow with the number of documents, so that strangers seldom meet."""
    bits = min(60, max(32, 8 * math.ceil((math.log2(max(2, count)) + 12) / 8)))
    p = differing_share(similarity)
    meets = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(2 * HALF + 1))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meets))


def routing(count: int, bits: int) -> tuple[int, int, int]:
    """(blocks, bits of a block, flips): of so many disjoint blocks one differs so little between any two values within
    ``2 * HALF`` bits that both sides, flipping so many of its bits at most, send it alike."""
    lead = max(2, math.ceil(math.log2(max(1, count) / PART_ROWS + 1)))
    blocks = 2 * HALF + 1
    if count >> min(lead, bits // blocks) <= MOST_PART_ROWS:
        return blocks, min(lead, bits // blocks), 0
    return 2, min(20, lead, bits // 2), (HALF + 1) // 2


def turned(values: np.ndarray, by: int, bits: int) -> np.ndarray:
    """The leading ``bits`` bits rotated left."""
    window = np.uint64(((1 << bits) - 1) << (64 - bits))
    return ((values << np.uint64(by)) | (values >> np.uint64(bits - by))) & window


def long_fingerprint(data: bytes | None, words: int, shingle: int = SHINGLE) -> np.ndarray:
    """``words`` 64-bit words: for each, the bitwise majority of differently mixed shingle hashes."""
    tokens = (data or b"").lower().split()
    out = np.zeros(words, dtype=np.uint64)
    if not tokens:
        return out
    joined = b" ".join(tokens)
    starts = list(accumulate((len(t) + 1 for t in tokens), initial=0))
    n = max(1, len(tokens) - shingle + 1)
    ones = np.zeros((words, 64), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 32768):
        part = range(at, min(n, at + 32768))
        h = np.array([digest(joined[starts[i] : starts[min(i + shingle, len(tokens))] - 1], SEED) for i in part], dtype=np.uint64)
        for k in range(words):
            mixed = mix64(h ^ np.uint64(k * 0x9E3779B1 + 1))
            ones[k] += np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0]


def long_fingerprints(docs: DataFrame, words: int, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, t1, t2, fp``: the hashes of the text and the fingerprint (array of longs)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([long_fingerprint(x, words, shingle) for x in byte_values(b.column("text"))], dtype=np.uint64).reshape(-1, words)
            made = pa.FixedSizeListArray.from_arrays(pa.array(fps.view(np.int64).ravel()), words).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "t1", "t2")), made], names=["doc_id", "t1", "t2", "fp"])

    return text_keys(docs).mapInArrow(score, "doc_id long, t1 long, t2 long, fp array<long>")


def table_values(fp: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Leading ``bits`` of 64-bit values, a column for each table, cut from the words behind the checking ones."""
    stream = np.unpackbits(fp[:, CHECK_WORDS:].astype(">u8").view(np.uint8).reshape(len(fp), -1), axis=1)[:, : bits * tables]
    padded = np.zeros((len(fp), tables, 64), dtype=np.uint8)
    padded[:, :, :bits] = stream.reshape(len(fp), tables, bits)
    return np.packbits(padded, axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def spread(value: np.ndarray, left: np.ndarray, have: int, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every way to flip up to ``left`` of the bits between the leading ``have`` and ``want``: (row, value, flips left)."""
    rows, values, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n, masks in enumerate(flip_masks(64 - want, 64 - have, int(left.max(initial=0)))):
        own = np.flatnonzero(left >= n)
        rows.append(np.repeat(own, len(masks)))
        values.append((value[own, None] ^ masks[None, :]).ravel())
        rest.append(np.repeat(left[own] - n, len(masks)))
    return np.concatenate(rows), np.concatenate(values), np.concatenate(rest)


def meet(value: np.ndarray, left: np.ndarray, have: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring rows among those that share a variant of ``bits`` bits, a variant at a time."""
    size = sum(int((left >= n).sum()) * math.comb(bits - have, n) for n in range(int(left.max(initial=0)) + 1))
    if size > CHUNK and bits - have > 6:
        rows, values, rest = spread(value, left, have, have + 4)
        key = values >> np.uint64(60 - have)
        order = np.argsort(key, kind="stable")
        found = [np.zeros((2, 0), np.int64)]
        for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(own) > 1:
                a, b = meet(values[own], rest[own], have + 4, bits)
                found.append(np.stack((rows[own[a]], rows[own[b]])))
        pairs = np.concatenate(found, axis=1)
    else:
        rows, values, _ = spread(value, left, have, bits)
        order = np.argsort(values)
        same = np.flatnonzero(np.diff(values[order]) == 0)
        pairs = np.stack((rows[order[same]], rows[order[same + 1]]))
    pairs = np.unique(np.sort(pairs, axis=0), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    return pairs[0], pairs[1]


def sweep(value: np.ndarray, left: np.ndarray, root: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Roots after every pair of rows with unlike roots that shares a variant was checked by ``near``; the rows of a
    part have equal leading bits. Members of a found component are not compared with each other again."""
    order = np.argsort(root, kind="stable")
    v, flips, r = value[order], left[order].astype(np.uint8), root[order]
    found, waiting = [np.stack((np.arange(len(root)), root))], 0
    for at in range(0, len(v), TILE[0]):
        own = slice(at, at + TILE[0])
        for col in range(int(np.searchsorted(r, r[at], "right")), len(v), TILE[1]):
            cols = slice(col, col + TILE[1])
            i, j = np.nonzero(np.bitwise_count(v[own, None] ^ v[None, cols]) <= flips[own, None] + flips[None, cols])
            i, j = i + at, j + col
            pair = (i < j) & (r[i] != r[j])
            a, b = order[i[pair]], order[j[pair]]
            ok = near(a, b)
            found.append(np.stack((a[ok], b[ok])))
            waiting += int(ok.sum())
            if waiting > CHUNK:
                root = local_roots(len(root), *np.concatenate(found, axis=1))
                found, waiting = [np.stack((np.arange(len(root)), root))], 0
    return local_roots(len(root), *np.concatenate(found, axis=1))


def _prints(docs: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, int, int]:
    """(fingerprints of every row, bits of a table, number of tables)."""
    bits, tables = tables_for(docs.count(), similarity)
    return cut_lineage(long_fingerprints(docs, CHECK_WORDS + -(-bits * tables // 64), shingle)), bits, tables


def links(distinct: DataFrame, similarity: float, bits: int, tables: int) -> DataFrame:
    """Edges ``a, b`` whose components are those of the links; ``distinct`` has ``fp, node``."""
    words = CHECK_WORDS + -(-bits * tables // 64)
    # the slack keeps pairs that are just similar enough
    share, checked = differing_share(similarity), 64 * CHECK_WORDS
    most = int(checked * share + SLACK * math.sqrt(checked * share * (1 - share)))
    blocks, lead, flips = routing(distinct.count(), bits)

    checks = [f"check{k}" for k in range(CHECK_WORDS)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").flatten().to_numpy().view(np.uint64).reshape(-1, words)
            node = b.column("node").to_numpy()
            for t, values in enumerate(table_values(fp, bits, tables).T):
                for block in range(blocks):
                    rows, value, left = spread(turned(values, block * lead, bits), np.full(len(fp), flips), 0, lead)
                    part = ((value >> np.uint64(64 - lead)).astype(np.int64) * blocks + block) * tables + t
                    columns = (pa.array(part), pa.array(value.view(np.int64)), pa.array((left + HALF - flips).astype(np.int8)), pa.array(node[rows]), *(pa.array(fp[rows, k].view(np.int64)) for k in range(CHECK_WORDS)))
                    yield pa.RecordBatch.from_arrays(list(columns), names=["part", "value", "left", "node", *checks])

    def collide(group: pa.Table) -> pa.Table:
        order = np.argsort(group["node"].to_numpy(), kind="stable")
        node, left = group["node"].to_numpy()[order], group["left"].to_numpy()[order].astype(np.int64)
        value, *check = (group[c].to_numpy()[order].view(np.uint64) for c in ("value", *checks))

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            differ = np.zeros(len(a), dtype=np.int16)
            at = np.arange(len(a))
            for c in check:  # most pairs are told apart by the first words
                differ[at] += np.bitwise_count(c[a[at]] ^ c[b[at]])
                at = at[differ[at] <= most]
            return differ <= most

        # neighbours first, which ties true groups in linear time; then every other pair that meets
        a, b = meet(value, left, lead, bits)
        ok = near(a, b)
        _, known = np.unique(group["comp"].to_numpy()[order], return_index=True)
        same = known[np.unique(group["comp"].to_numpy()[order], return_inverse=True)[1]]
        a, b = np.concatenate((a[ok], np.arange(len(node)))), np.concatenate((b[ok], same))
        root = sweep(value, left, local_roots(len(node), a, b), near)
        other = np.flatnonzero(node[root] != node)
        return pa.table({"a": node[other], "b": node[root[other]]})

    sent = distinct.select("fp", "node").mapInArrow(emit, "part long, value long, left byte, node long, " + ", ".join(f"{c} long" for c in checks))
    hot = sent.groupBy("part").count().where(F.col("count") > HOT_ROWS).select(F.col("part").alias("hot_part"), F.ceil(F.col("count") / TILE_ROWS).cast("long").alias("tiles"))
    hot = cut_lineage(hot)
    rows = sent.join(hot, sent.part == hot.hot_part, "left").drop("hot_part")
    tile = F.coalesce(F.pmod(F.xxhash64("node"), F.col("tiles")), F.lit(0))
    tied = rows.withColumn("tile", tile).withColumn("comp", F.col("node")).groupBy("part", "tile").applyInArrow(collide, "a long, b long").distinct()
    if hot.isEmpty():
        return tied
    tied = cut_lineage(tied)
    # within the hot parts: all but the largest class of a part visit each of its tiles
    classes = connected_components(tied).withColumnRenamed("node", "n")
    rows = sent.join(hot, sent.part == hot.hot_part).join(classes, F.col("node") == F.col("n"), "left").withColumn("comp", F.coalesce("component", "node")).drop("n", "component", "hot_part")
    largest = rows.groupBy("part", "comp").count().groupBy("part").agg(F.max_by("comp", F.struct("count", "comp")).alias("largest"), F.count("*").alias("classes")).where("classes > 1")
    rows = rows.join(largest.withColumnRenamed("part", "p"), F.col("part") == F.col("p"))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("tiles")))
    rows = rows.withColumn("tile", F.explode(F.when(F.col("comp") == F.col("largest"), own).otherwise(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))))
    crossed = rows.select(*sent.columns, "tile", "comp").groupBy("part", "tile").applyInArrow(collide, "a long, b long")
    return tied.unionByName(crossed).distinct()


def similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs``: the smallest doc_id reachable over links of ``similarity`` or more.

    The similarity is the one that the checking bits measure (a standard error of 0.016 at 0.8; pairs of 0.74 pass half the time), on shingles
    of ``shingle`` words, repeats counted. Texts without words are alike. A row without doc_id links nothing
    and has a null component. Repeated rows come back as often as they are given; an empty table gives an
    empty result.
    """
    prints, bits, tables = _prints(docs, similarity, shingle)
    distinct = cut_lineage(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = connected_components(links(distinct, similarity, bits, tables))
    classes = distinct.join(found, "node", "left").select(F.col("fp").alias("k"), F.coalesce("component", "node").alias("c"))
    return prints.join(classes, prints.fp == classes.k, "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row of each near-duplicate class of ``docs``: that with the smallest doc_id, of unlike texts with one doc_id that
    with the smaller hash. Classes are of texts, so unlike texts with one doc_id both stay. Rows without doc_id link
    nothing and stay; an empty table stays empty. All columns stay, whatever their names and types. Fingerprints are told
    apart by 64-bit hashes of themselves."""
    prints, bits, tables = _prints(docs, similarity, shingle)
    distinct = prints.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("first"))
    distinct = cut_lineage(distinct.withColumn("node", F.xxhash64("fp")))
    return keep_rows(docs, prints, distinct, connected_components(links(distinct, similarity, bits, tables)))
