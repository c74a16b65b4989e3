"""Mixing sources to target weights by block permutations.

The documents of a source, one behind another, are cut into blocks of a fixed number of words, a smaller one for sources
that would have too few blocks to come near their target. The output is
a row of shards with a fixed number of slots; each shard draws how many of its slots each source gets. The
draws are multinomial under the condition that a source's slots add up to its share. They form two binary
trees, one over ranges of shards and one over ranges of sources: what a range of sources gets in the left half
of a range of shards is a seeded hypergeometric draw, and so is how its own left half shares in that. A task
therefore finds the counts of its own sources in its own shards alone. The k-th slot of a source takes the
block that a keyed permutation of the source's block numbers puts at k (with a new key once all blocks are
used), and slots and blocks are joined by block number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import numbered
from .common import cut_lineage, mix64

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 128
#: Blocks that a source has at least, as far as it has so many words.
LEAST_BLOCKS = 48
SHARD_SLOTS = 1024
SEED = 20240607
#: Rows of a group in which running sums are taken.
GROUP_ROWS = 500
#: Numbers that the driver sees of all sources, which are summed in ranges; slots of a group that is filled, and tasks for those.
MOST_RANGES = 4096
RANGE_SOURCES = 64
TASK_SLOTS = 1 << 16
MOST_TASKS = 1 << 15
#: Outcomes up to which a draw is made by summing their probabilities.
FEW = 32
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words each source should give: by weight, none above ``most`` times its size, the excess reshared."""
    out = [0.0] * len(sizes)
    free, rest = set(range(len(sizes))), share * sum(sizes)
    while free:
        unit = rest / sum(weights[i] for i in free)
        over = [i for i in sorted(free) if unit * weights[i] > most * sizes[i]]
        for i in over or sorted(free):
            out[i] = float(most * sizes[i]) if over else unit * weights[i]
        rest -= sum(out[i] for i in over)
        if not over:
            break
        free -= set(over)
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 puts each index: a four-round Feistel network, walked until in range."""
    half = max(1, math.ceil(math.log2(max(2, n)) / 2))
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mix64(right + np.uint64((key * 4 + r) * 0x10001 + 1 & 0xFFFFFFFFFFFF)) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = out >= n
    return out.astype(np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of ``take`` draws without replacement are good, at any size."""
    if not (good and bad and take) or take == good + bad:
        return 0 if not (good and take) else min(good, take)
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, take))
    return outward(rng.random(), good, bad, take)


def outward(u: float, good: int, bad: int, take: int, step: int = 1 << 16) -> int:
    """The same from one uniform number, by the ratios of neighbouring probabilities: they are added up from the likeliest outcome
    outwards until what is left is below the precision of their sum."""
    low, high = max(0, take - bad), min(good, take)
    middle = min(high, max(low, (take + 1) * (good + 1) // (good + bad + 2)))

    def side(sign: int) -> list[np.ndarray]:
        """Weights of the outcomes beyond the middle, which itself has weight one."""
        out, last, k = [], 1.0, middle
        end = high if sign > 0 else low
        while k != end and last > 1e-18:
            n = min(step, abs(end - k))
            at = k + sign * np.arange(n, dtype=np.float64)  # exact: outcomes are below 2 ** 53
            if sign > 0:
                ratio = (good - at) * (take - at) / ((at + 1) * (bad - take + at + 1))
            else:
                ratio = at * (bad - take + at) / ((good - at + 1) * (take - at + 1))
            out.append(last * np.cumprod(ratio))
            last, k = float(out[-1][-1]), k + sign * n
        return out

    below, above = side(-1), side(1)
    left = u * (1.0 + sum(float(x.sum()) for x in below) + sum(float(x.sum()) for x in above))
    if left < 1.0:
        return middle
    left -= 1.0
    for parts, sign in ((below, -1), (above, 1)):
        k = middle
        for x in parts:
            whole = float(x.sum())
            if left < whole:
                return k + sign * (1 + min(len(x) - 1, int(np.searchsorted(np.cumsum(x), left, side="right"))))
            left -= whole
            k += sign * len(x)
    return middle


def few_of(u: float, good: int, bad: int, take: int) -> int:
    """The same draw from one uniform number, by summing probabilities: quick where few outcomes are possible."""
    low, high, rest = max(0, take - bad), min(good, take), bad - take
    g = math.lgamma
    p = math.exp(g(good + 1) - g(low + 1) - g(good - low + 1) + g(bad + 1) - g(take - low + 1) - g(rest + low + 1) - g(good + bad + 1) + g(take + 1) + g(good + rest + 1))
    k = low
    while u > p and k < high:
        u -= p
        p *= (good - k) * (take - k) / ((k + 1) * (rest + k + 1))
        k += 1
    return k


class ShardCounts:
    """How many slots of each shard each source gets, and how many it got in the shards before.

    ``ranges`` has the slots of each range of ``width`` neighbouring sources. The sources of one range, its
    ``quotas``, are all that ``within`` needs beside it.
    """

    def __init__(self, ranges: list[int], width: int = 1, slots: int = SHARD_SLOTS, seed: int = SEED) -> None:
        self.width, self.slots, self.seed = width, slots, seed
        self.leaves = 1 << max(0, (len(ranges) - 1).bit_length())
        # sums of the nodes of a binary tree over the ranges: children of n are 2 n and 2 n + 1
        self.sums = [0] * self.leaves + list(ranges) + [0] * (self.leaves - len(ranges))
        for n in range(self.leaves - 1, 0, -1):
            self.sums[n] = self.sums[2 * n] + self.sums[2 * n + 1]
        self.total = self.sums[1]
        self.shards = -(-self.total // slots)
        self._path = lru_cache(1024)(self._draw_path)

    def _draw(self, low: int, high: int, level: int, node: int, good: int, bad: int, take: int) -> int:
        if not (good and bad and take) or take == good + bad:
            return min(good, take) if good else 0
        code = int.from_bytes(blake2b(b"%d,%d,%d,%d,%d" % (self.seed, low, high, level, node), digest_size=8).digest(), "big")
        if min(good, take) <= FEW and good + bad < 1_000_000_000:
            return few_of((code >> 11) / 2**53, good, bad, take)
        return hypergeometric(np.random.Generator(np.random.PCG64(code)), good, bad, take)

    def _halves(self, low: int, high: int) -> tuple[int, int]:
        """The middle of a range of shards, and the slots before it in the range."""
        mid = (low + high) // 2
        return mid, min(mid * self.slots, self.total) - low * self.slots

    def _draw_path(self, low: int, high: int, leaf: int, sums: tuple[tuple[int, int], ...]) -> tuple[tuple[tuple[int, int], ...], int]:
        """Of the left half of shards: the children's counts at each node on the way to a leaf, and the leaf's own."""
        _, take = self._halves(low, high)
        out = []
        depth = self.leaves.bit_length() - 1
        for d, (left, right) in enumerate(sums):
            node = (self.leaves + leaf) >> (depth - d)
            first = self._draw(low, high, 0, node, left, right, take)
            out.append((first, take - first))
            take = out[-1][leaf >> (depth - d - 1) & 1]
        return tuple(out), take

    def _shared(self, low: int, high: int, leaf: int, counts: np.ndarray, take: int) -> np.ndarray:
        """How the sources of a range share what it takes in the left half of shards."""
        out = np.zeros(len(counts), dtype=np.int64)
        todo = [(0, self.width, take)]
        sums = np.concatenate(([0], np.cumsum(counts)))
        while todo:
            a, b, n = todo.pop()
            b = min(b, len(counts))
            if not n or a >= len(counts):
                continue
            if b - a == 1 or n == sums[b] - sums[a]:
                out[a:b] = counts[a:b] if b - a > 1 else n
                continue
            mid = (a + b) // 2
            first = self._draw(low, high, 1 + leaf, a * self.width + b, int(sums[mid] - sums[a]), int(sums[b] - sums[mid]), n)
            todo += [(a, mid, first), (mid, b, n - first)]
        return out

    def within(self, leaf: int, quotas: np.ndarray, low: int = 0, high: int | None = None, every: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, counts, counts of all shards before) of the sources of range ``leaf`` in the shards low..high-1,
        with ``every`` also those that hold nothing of them."""
        depth = self.leaves.bit_length() - 1
        top = tuple((self.sums[2 * n], self.sums[2 * n + 1]) for n in ((self.leaves + leaf) >> (depth - d) for d in range(depth)))
        todo = [(0, self.shards, top, np.asarray(quotas, dtype=np.int64), np.zeros(len(quotas), dtype=np.int64))]
        high = self.shards if high is None else high
        while todo:
            a, b, sums, counts, before = todo.pop()
            if b <= low or a >= high or not (every or counts.any()):
                continue
            if b - a == 1:
                yield a, counts, before
                continue
            mid, take = self._halves(a, b)
            left_sums, take = self._path(a, b, leaf, sums) if sums else ((), take)
            left = self._shared(a, b, leaf, counts, take)
            right_sums = tuple((x - u, y - v) for (x, y), (u, v) in zip(sums, left_sums, strict=True))
            todo += [(mid, b, right_sums, counts - left, before + left), (a, mid, left_sums, left, before)]


    def of(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """(counts of the shard, counts of all shards before it) of all sources, where each range is one source."""
        found = [next(self.within(k, np.array([self.sums[self.leaves + k]]), shard, shard + 1, every=True)) for k in range(self.leaves)]
        return np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])


def block_words(source_size: Column) -> Column:
    """Words of a source's blocks."""
    return F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(source_size / LEAST_BLOCKS))).cast("long")


def _sources(base: DataFrame) -> DataFrame:
    """``source, source_no, source_size, target, blocks, quota`` of each source.

    The targets come from one aggregate over the table of sources for each round of resharing.
    """
    found = numbered(base.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last(), name="source_no")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    found = cut_lineage(found.withColumn("weight", weight))
    whole = found.agg(F.sum("source_size")).first()[0] or 0
    unit = 0.0
    while True:
        over = F.col("source_size") * MOST < F.lit(unit) * F.col("weight")
        r = found.agg(F.sum(F.when(over, F.col("source_size") * MOST)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        now = (SHARE * whole - (r.full or 0)) / r.free if r.free else unit
        if now <= unit:
            break
        unit = now
    blocks = F.ceil(F.col("source_size") / block_words(F.col("source_size"))).cast("long")
    found = found.withColumn("target", F.least((F.col("source_size") * MOST).cast("double"), F.lit(unit) * F.col("weight"))).withColumn("blocks", blocks)
    quota = F.when(F.col("source_size") > 0, F.least(F.col("blocks") * MOST, F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(F.lit(0))
    return cut_lineage(found.withColumn("quota", quota.cast("long")).drop("weight"))


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, source_no, source_size, target, size, start`` of every document, the table of sources).

    ``start`` counts the words of the source before this document. Rows that agree in source, doc_id and size are
    one row with a count until the sums are taken, so they are no hot key. Running sums are taken in hashed groups
    of a bounded number of rows, and over the sums of those groups, so no task holds the rows of a source.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    base = cut_lineage(base.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")).withColumn("words", F.col("size") * F.col("copies")))
    sources = _sources(base.select("source", F.col("words").alias("size")))
    groups = max(1, base.count() // GROUP_ROWS)
    rows = base.withColumn("grp", F.pmod(F.xxhash64("doc_id", "size"), F.lit(groups)))
    sums = rows.groupBy("source", "grp").agg(F.sum("words").alias("n"))
    # the groups of a source are themselves summed in steps, so that many groups are no long window either
    step = F.floor(F.col("grp") / max(1, math.isqrt(groups)))
    sums = sums.withColumn("step", step)
    ahead = Window.partitionBy("source", "step").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    steps = sums.groupBy("source", "step").agg(F.sum("n").alias("n"))
    steps_ahead = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(F.col("source").alias("so"), F.col("step").alias("st"), F.coalesce(F.sum("n").over(steps_ahead), F.lit(0)).alias("earlier"))
    steps = steps.join(sources.withColumnRenamed("source", "name"), F.col("so").eqNullSafe(F.col("name")))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    sums = sums.join(steps, F.col("source").eqNullSafe(F.col("so")) & (F.col("step") == F.col("st"))).select(F.col("source").alias("s"), F.col("grp").alias("g"), (F.col("before") + F.col("earlier")).alias("before"), "source_no", "source_size", "target")
    within = Window.partitionBy("source", "grp").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("words").over(within), F.lit(0)))
    rows = rows.join(sums.hint("merge"), F.col("s").eqNullSafe(F.col("source")) & (F.col("g") == F.col("grp")))
    rows = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(65536).cast("long"))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + 65535, F.col("copies") - 1))))
    return rows.select("doc_id", "source_no", "source_size", "target", "size", (F.col("before") + F.col("inside") + F.col("copy") * F.col("size")).alias("start")), sources


def slots(sources: DataFrame) -> DataFrame:
    """``shard, slot, source_no, block`` of every slot of the mix; in a shard they stand in the order of ``slot``, a random code."""
    last = sources.agg(F.max("source_no")).first()[0]
    width = max(RANGE_SOURCES, 1 << max(0, ((0 if last is None else last) // MOST_RANGES).bit_length()))
    near = sources.withColumn("leaf", F.floor(F.col("source_no") / width))
    sums = {r.leaf: r.n for r in near.groupBy("leaf").agg(F.sum("quota").alias("n")).collect()}
    plan = ([sums.get(i, 0) for i in range(1 + max(sums, default=0))], width)
    shards = ShardCounts(*plan).shards
    # each range of sources is filled by as many tasks as it has slots for, each for its own shards
    filled = near.groupBy("leaf").agg(F.sum("quota").alias("n")).where("n > 0")
    filled = filled.select(F.col("leaf").alias("l"), F.least(F.lit(max(1, shards)), F.ceil(F.col("n") / TASK_SLOTS).cast("long")).alias("cuts"))
    filled = filled.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    # few bytes make many slots, so the number of tasks follows the slots
    tasks = max(1, min(MOST_TASKS, sum(-(-n // TASK_SLOTS) for n in sums.values())))
    dealt = near.join(filled, F.col("leaf") == F.col("l")).select("leaf", "cut", "cuts", "source_no", "quota", "blocks").repartition(tasks, "leaf", "cut")

    def fill(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        counts = ShardCounts(*plan)
        leaf, cut, cuts = int(own["leaf"][0]), int(own["cut"][0]), int(own["cuts"][0])
        first = leaf * width
        quotas, blocks = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        quotas[own["source_no"] - first], blocks[own["source_no"] - first] = own["quota"], own["blocks"]
        made: dict[str, list[np.ndarray]] = {"shard": [], "source_no": [], "nth": []}
        for shard, n, before in counts.within(leaf, quotas, shards * cut // cuts, shards * (cut + 1) // cuts):
            source = np.repeat(np.arange(width), n)
            made["shard"].append(np.full(len(source), shard))
            made["source_no"].append(source)
            made["nth"].append(np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(before, n))
        shard, source, nth = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in made.values())
        block = np.zeros(len(source), dtype=np.int64)
        order = np.argsort(source, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(source[order])) + 1) if len(order) else ():
            s = int(source[rows[0]])
            turn = nth[rows] // blocks[s]
            for t in np.unique(turn):
                block[rows[turn == t]] = permuted(nth[rows[turn == t]] % blocks[s], int(blocks[s]), (first + s) * MOST + int(t))
        # slots stand in a shard in the order of a keyed code of theirs
        code = mix64(mix64(mix64(shard.astype(np.uint64) ^ np.uint64(SEED)) ^ (source + first).astype(np.uint64)) ^ nth.astype(np.uint64))
        return pd.DataFrame({"shard": shard, "slot": (code >> np.uint64(1)).astype(np.int64), "source_no": source + first, "block": block})

    return dealt.groupBy("leaf", "cut").applyInPandas(fill, "shard long, slot long, source_no long, block long")


def _blocks_of(rows: DataFrame) -> DataFrame:
    """A row for each block that a document with words lies in."""
    rows = rows.where("size > 0").withColumn("words", block_words(F.col("source_size")))
    return rows.withColumn("block", F.explode(F.sequence(F.expr("start div words"), F.expr("(start + size - 1) div words"))))


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    Sizes are words, a null text has none. A null source is a source of its own and comes last. Texts without
    words take none. Rows with equal or null doc_id count as separate documents; an empty table gives an
    empty result. The draws depend on the seed and the data alone, so reruns agree.
    """
    rows, sources = placed(docs)
    rows = cut_lineage(rows)
    uses = slots(sources).groupBy("source_no", "block").agg(F.count("*").alias("uses"))
    cut = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("words")) - F.greatest(F.col("start"), F.col("block") * F.col("words"))
    about = ["doc_id", "source_no", "source_size", "target", "size", "start"]
    parts = _blocks_of(rows).join(uses.hint("merge"), ["source_no", "block"], "left").select(*about, (cut * F.coalesce("uses", F.lit(0))).alias("part"))
    taken = parts.groupBy(*about).agg(F.sum("part").alias("taken"))
    taken = taken.unionByName(rows.where("size = 0").select(*about, F.lit(0).cast("long").alias("taken")))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """``shard, slot, source_no, block, text``: the mix itself, a row for each slot, of at most BLOCK words.

    Documents are told apart by doc_id here, which must be unique.
    """
    rows, sources = placed(docs)
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all("text", F.lit(f"({_WORD})"), F.lit(1)).alias("words"))
    begin, first = F.greatest(F.col("block") * F.col("length") - F.col("start"), F.lit(0)), F.greatest("start", F.col("block") * F.col("length"))
    pieces = _blocks_of(rows).withColumnRenamed("words", "length").join(words, "doc_id").select("source_no", "block", "start", F.array_join(F.slice("words", (begin + 1).cast("int"), F.least(F.col("size") - begin, (F.col("block") + 1) * F.col("length") - first).cast("int")), " ").alias("piece"))
    packed = pieces.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("p"))
    packed = packed.select("source_no", "block", F.array_join(F.col("p.piece"), " ").alias("text"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("slot", "source_no", "block")) - 1
    return slots(sources).withColumn("slot", place).join(packed, ["source_no", "block"]).select("shard", "slot", "source_no", "block", "text")
