"""Mixing: draws at every size, many sources, repeated rows, and the whole mix in plain Python."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import mixing


@pytest.mark.parametrize("numbers", [(700, 300, 100), (3 * 10**9, 10**9, 2 * 10**9), (50, 4 * 10**9, 10**9), (4 * 10**9, 50, 10**9), (2 * 10**9, 3 * 10**9, 60), (2 * 10**9, 3 * 10**9, 5 * 10**9 - 60)])
def test_hypergeometric_has_the_right_mean_and_spread(numbers):
    good, bad, take = numbers
    rng = np.random.Generator(np.random.PCG64(1))
    drawn = np.array([mixing.hypergeometric(rng, *numbers) for _ in range(4000)], dtype=float)
    total = good + bad
    mean = take * good / total
    spread = math.sqrt(mean * (bad / total) * (total - take) / (total - 1))
    assert max(0, take - bad) <= drawn.min() and drawn.max() <= min(good, take)
    assert abs(drawn.mean() - mean) < 5 * spread / math.sqrt(4000) and 0.94 < drawn.std() / spread < 1.06


@pytest.mark.parametrize("numbers", [(5, 7, 4), (1, 900, 3), (30, 10**8, 10**6), (10**6, 10**7, 20), (40, 20, 32)])
def test_few_outcomes_have_the_right_mean_and_spread(numbers):
    good, bad, take = numbers
    drawn = np.array([mixing.few_of((i + 0.5) / 5000, *numbers) for i in range(5000)], dtype=float)
    total = good + bad
    mean = take * good / total
    spread = math.sqrt(mean * (bad / total) * (total - take) / (total - 1))
    assert max(0, take - bad) <= drawn.min() and drawn.max() <= min(good, take)
    assert abs(drawn.mean() - mean) < 0.02 * spread + 1e-3 and abs(drawn.std() - spread) < 0.05 * spread + 0.01


def test_counts_of_many_billions():
    quotas = [5 * 10**9, 3, 2 * 10**9, 0, 10**10, 77, 10**6]
    plan = mixing.ShardCounts(quotas)
    for shard in (0, 1, 12345, plan.shards // 2, plan.shards - 2):
        (counts, before), (_, after) = plan.of(shard), plan.of(shard + 1)
        assert counts.sum() == mixing.SHARD_SLOTS and (before + counts == after).all()
    counts, before = plan.of(plan.shards - 1)
    assert (before + counts)[: len(quotas)].tolist() == quotas
    firsts = np.array([plan.of(s)[0] for s in range(0, plan.shards, plan.shards // 300)])
    assert np.abs(firsts[:, 0].mean() / mixing.SHARD_SLOTS - quotas[0] / sum(quotas)) < 0.01


@pytest.mark.parametrize("width", [1, 4, 64])
def test_tasks_agree_on_their_shares(width):
    """Ranges of sources and of shards, each by itself, put together to the whole: rows and columns add up."""
    rng = np.random.Generator(np.random.PCG64(width))
    quotas = np.where(rng.random(150) < 0.3, 0, rng.integers(0, 400, 150))
    ranges = [int(quotas[i : i + width].sum()) for i in range(0, len(quotas), width)]
    plan = mixing.ShardCounts(ranges, width, slots=64)
    table = np.zeros((plan.shards, len(ranges) * width), dtype=int)
    for leaf in range(len(ranges)):
        own = np.zeros(width, dtype=int)
        own[: len(quotas[leaf * width : (leaf + 1) * width])] = quotas[leaf * width : (leaf + 1) * width]
        at = 0
        for low, high in ((0, plan.shards // 3), (plan.shards // 3, plan.shards)):
            for shard, counts, before in mixing.ShardCounts(ranges, width, slots=64).within(leaf, own, low, high):
                table[shard, leaf * width : (leaf + 1) * width] = counts
                assert (before == table[:shard, leaf * width : (leaf + 1) * width].sum(axis=0)).all() and shard >= at
                at = shard
    assert table.sum(axis=0)[: len(quotas)].tolist() == quotas.tolist()
    assert (table.sum(axis=1)[:-1] == 64).all()


def test_many_sources_and_repeated_rows(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.expr("array_join(array_repeat('w', cast(id % 7 as int)), ' ')").alias("text"))
    r = mixing.mix(d).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).first()
    assert r.n == 20_000 and r.over <= 0 and abs(r.target - 1.5 * r["size"]) < 1
    d = spark.range(300_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one").alias("source"), F.lit("a b c").alias("text"))
    r = mixing.mix(d).agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("taken").alias("most"), F.max("target").alias("target")).first()
    assert r.n == 300_000 and r.most <= 6 and abs(r.taken - r.target) < 0.01 * r.target


def test_mix_in_plain_python(spark):
    """Blocks, permutations and draws by plain loops over the documents in their places."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, sources = mixing.placed(d)
    sources = sorted(map(lambda r: r.asDict(), sources.collect()), key=lambda s: s["source_no"])
    assert [s["source"] for s in sources] == sorted({r.source for r in d.collect()})
    words = {r.doc_id: len((r.text or "").split()) for r in d.collect()}
    sizes = collections.Counter()
    for r in d.collect():
        sizes[r.source] += words[r.doc_id]
    aims = mixing.targets([sizes[s["source"]] for s in sources], [mixing.WEIGHTS[i % 3] for i in range(len(sources))])
    assert [s["target"] for s in sources] == pytest.approx(aims)
    used = collections.Counter()
    for s in sources:
        for k in range(s["quota"]):
            turn, nth = divmod(k, s["blocks"])
            used[s["source_no"], int(mixing.permuted(np.array([nth]), s["blocks"], s["source_no"] * mixing.MOST + turn)[0])] += 1
    assert used == {(r.source_no, r.block): r["count"] for r in mixing.slots(mixing.placed(d)[1]).groupBy("source_no", "block").count().collect()}
    want = {}
    for r in rows.collect():
        want[r.doc_id] = sum(used[r.source_no, (r.start + i) // max(1, min(mixing.BLOCK, r.source_size // mixing.LEAST_BLOCKS))] for i in range(r["size"]))
    assert want == {r.doc_id: r.taken for r in mixing.mix(d).collect()}
    per_shard = mixing.slots(sources=mixing.placed(d)[1]).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in per_shard)[1:] == [mixing.SHARD_SLOTS] * (len(per_shard) - 1)


@pytest.mark.parametrize("numbers", [(7, 5, 6), (40, 200, 60), (3, 1000, 500), (200, 3, 150), (1, 1, 1)])
def test_outward_sums_are_the_distribution(numbers):
    good, bad, take = numbers
    whole = math.comb(good + bad, take)
    mass = collections.Counter(mixing.outward((i + 0.5) / 20_000, good, bad, take, step=16) for i in range(20_000))
    for k in range(max(0, take - bad), min(good, take) + 1):
        assert abs(mass[k] / 20_000 - math.comb(good, k) * math.comb(bad, take - k) / whole) < 2e-3


def test_small_sources_come_near_their_targets(spark):
    """Sources of 40 to 300 words, far below a block each, in documents of 1 to 60 words."""
    rng = np.random.Generator(np.random.PCG64(9))
    docs, n = [], 0
    for source, size in enumerate([40, 60, 75, 100, 130, 165, 200, 250, 300]):
        while size:
            own = min(size, int(rng.integers(1, 60)))
            docs.append((n, f"s{source}", "w " * own))
            n, size = n + 1, size - own
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert r.taken <= 2 * r["size"]
    assert len(target) == 9 and all(abs(taken[s] / target[s] - 1) <= 0.05 for s in target)
