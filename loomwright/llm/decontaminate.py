"""Benchmark decontamination by CGK embeddings and bit sampling.

The CGK walk (Chakraborty, Goldenberg, Koucky, 2016) writes a word sequence out as a longer one: at each step
it emits the word under its pointer, and a random bit of that word and step decides whether the pointer
moves on. Two sequences with few edits give walks that fall into step again, so their edit distance becomes
a Hamming distance, and sampled coordinates of the walk make a locality-sensitive hash. Item-sized windows
of the documents and the items meet on such keys in a join; a number of independent repetitions reaches the
target recall. Each pair that meets is then checked by the exact edit distance of words.

Before the walk, windows that cannot hold an item are passed over: an edit destroys two word pairs at most,
so a window within the distance keeps a known number of an item's word pairs. A bitmap of the items' pairs, of
at most FILTER_BITS whatever their number, tells which may be one; it never misses a pair. What is left are regions
of texts with the starts of their windows. Equal regions, such as a passage that a third of all documents share,
are keyed, joined and checked once. The documents are read once, however many items there are.

Items that share a template have keys in common with each other and with all its uses. In such a key an item is told apart by
its words that most of the key's items lack: of more than the edits allowed at least one is left in any match, so pairs
meet on key and such a word; only items within their edits of the template meet all its uses, which they match.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, mix64, written
from .hashing import words_of

#: Edits allowed, as a share of an item's words (a similarity of 0.8), and the recall aimed at there.
EDIT_SHARE = 0.2
RECALL = 0.95
#: Coordinates in a key.
SAMPLED = 2
#: Bits of the bitmap at most (64 MB), and bits for each pair below that.
FILTER_BITS, PAIR_BITS = 1 << 29, 32
_BLOCK_BITS = 1 << 16
#: Regions of a task that writes keys or checks pairs, and such tasks at most.
TASK_REGIONS, MOST_TASKS = 4000, 1 << 15
#: Items of a key from which pairs must also share a word that tells those items apart.
HOT_ITEMS = 64
#: Words of an item from which it is searched for. Items of one word are found exactly too, if asked for: they are in
#: so many texts that a search for them says little.
MIN_WORDS = 2

_BREAKS = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])
_WIDE_PUNCTUATION = re.compile("[ -¿ -⁯　-〃]")


def folded(text: str | None) -> bytes:
    """Lower case, with punctuation outside ASCII as spaces."""
    low = (text or "").lower()
    return (low if low.isascii() else _WIDE_PUNCTUATION.sub(" ", low)).encode("utf-8", "replace")


def walk_keys(codes: np.ndarray, starts: np.ndarray, size: int, repetition: int) -> np.ndarray:
    """Key of the window of ``size`` words at each start: sampled coordinates of its CGK walk."""
    rng = np.random.Generator(np.random.PCG64([size, repetition]))
    wanted = np.sort(rng.choice(2 * size, min(SAMPLED, 2 * size), replace=False))
    seed = mix64(np.array([repetition + 1], dtype=np.uint64))[0]
    pointer, key = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), seed, dtype=np.uint64)
    for step in range(int(wanted[-1]) + 1):
        word = np.where(pointer < size, codes[np.minimum(starts + pointer, len(codes) - 1)], np.uint64(0))
        if step in wanted:
            key = mix64(key ^ word)
        pointer += (mix64(word ^ (seed + np.uint64(step * 2 + 1))) & np.uint64(1)).astype(np.int64)
    return key


def allowed(words: int) -> int:
    return int(words * EDIT_SHARE + 1e-9)


def class_bounds(words: int) -> tuple[int, int]:
    """(fewest, most) words of the items that share a class with those of ``words``: none is more than a quarter longer
    than another. They are the same for any set of items."""
    low = 1
    while (high := int(low * 1.25)) < words:
        low = high + 1
    return low, high


@lru_cache(maxsize=None)
def repetitions(size: int, most: int, recall: float = RECALL) -> int:
    """How many repetitions of windows of ``size`` words find items of ``size`` to ``most`` words with the most edits
    allowed, measured on seeded random edits of those that allow the most for their length."""
    rng = np.random.Generator(np.random.PCG64(size))
    words = max(range(size, most + 1), key=lambda n: (allowed(n) / n, n))
    edits, trials, seeds = allowed(words), 200, 8
    if not edits:
        return 1
    ones, twos = [], []
    for _ in range(trials):
        one = rng.integers(1, 2**63, words, dtype=np.uint64)
        two = one.tolist()
        for _ in range(edits):
            at, kind = int(rng.integers(len(two))), int(rng.integers(3))
            two[at : at + (kind != 1)] = [] if kind == 0 and len(two) > 1 else [int(rng.integers(1, 2**63))]
        ones.append(one[:size])
        twos.append(np.concatenate((np.array(two, dtype=np.uint64), rng.integers(1, 2**63, size, dtype=np.uint64)))[:size])
    starts = np.arange(trials) * size
    met = sum(int((walk_keys(np.concatenate(ones), starts, size, r) == walk_keys(np.concatenate(twos), starts, size, r)).sum()) for r in range(seeds))
    trials *= seeds
    return math.ceil(math.log(1 - recall) / math.log(1 - min(max(met, 1) / trials, 0.99)))


@dataclass(frozen=True)
class SizeClass:
    """Items of ``size`` to ``most`` words; windows have the smallest size of the class."""

    size: int
    most: int
    repetitions: int

    @property
    def pairs_needed(self) -> int:
        return max(1, self.size - 1 - 2 * allowed(self.most))


def size_classes(items: list[np.ndarray], min_words: int = MIN_WORDS) -> list[SizeClass]:
    """Classes of the items by ``class_bounds``; items under ``min_words`` words are in none."""
    return _classes({class_bounds(len(x)) for x in items if len(x) >= max(1, min_words)})


def _classes(bounds: set[tuple[int, int]]) -> list[SizeClass]:
    return [SizeClass(low, high, repetitions(low, high)) for low, high in sorted(bounds)]


def _marks(codes: np.ndarray, size: int) -> np.ndarray:
    """Codes of the word pairs, one for each word; of the words themselves for classes of single words."""
    return codes if size == 1 else codes * np.uint64(0x9E3779B97F4A7C15) + np.append(codes[1:], np.uint64(0))


def _of_class(marks: np.ndarray, size: int) -> np.ndarray:
    return mix64(marks ^ np.uint64(size * 0x51_7C_C1))


def filter_places(codes: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Bits that an item sets: for its pairs, and for its pairs as those of its class."""
    marks = _marks(codes, size)[: max(1, len(codes) - 1) if size > 1 else len(codes)]
    return np.unique(np.concatenate((mix64(marks), _of_class(marks, size))) & np.uint64(bits - 1)).astype(np.int64)


def _is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _full_windows(hits: np.ndarray, size: int, need: int) -> np.ndarray:
    """Starts of the windows of ``size`` words that hold ``need`` of the pairs at ``hits`` (ascending) or more."""
    if len(hits) < need:
        return np.zeros(0, dtype=np.int64)
    reach = max(0, size - 2)
    low, high = hits[: len(hits) - need + 1], hits[need - 1 :]
    dense = high - low <= reach
    low, high = low[dense], np.maximum(0, high[dense] - reach)
    n = low - high + 1
    return np.unique(np.repeat(high - np.cumsum(n) + n, n) + np.arange(n.sum()))


def regions_in(texts: list[str | None], classes: list[SizeClass], bitmap: np.ndarray) -> Iterator[tuple[int, SizeClass, int, np.ndarray, np.ndarray]]:
    """(text, class, first word, word codes, starts of windows) of the parts of each text that may hold an item of a class."""
    words = words_of([folded(x) for x in texts], _BREAKS)
    slack = max((allowed(c.most) for c in classes), default=0) + 1
    # the texts' words with free room behind each text, for windows that an edited item leaves short
    lengths = np.diff(words.first)
    first = words.first[:-1] + np.arange(len(lengths)) * slack
    codes = np.zeros(len(words.code) + slack * len(lengths), dtype=np.uint64)
    codes[np.arange(len(words.code)) + np.repeat(np.arange(len(lengths)) * slack, lengths)] = words.code
    owner = np.repeat(np.arange(len(lengths)), lengths + slack)
    pairs = _marks(codes, 2)
    hits = np.flatnonzero(_is_set(bitmap, mix64(pairs))) if any(c.size > 1 for c in classes) else np.zeros(0, np.int64)
    for c in classes:
        if c.size == 1:
            own = np.flatnonzero(_is_set(bitmap, _of_class(codes, 1)))
            own = own[own - first[owner[own]] < lengths[owner[own]]]
        else:
            own = hits[_is_set(bitmap, _of_class(pairs[hits], c.size))]
        starts = _full_windows(own, c.size, c.pairs_needed)
        starts = starts[starts + c.size <= len(codes)]
        starts = starts[starts + c.size <= (first + lengths + slack)[owner[starts]]]
        if not len(starts):
            continue
        edits = allowed(c.most)
        text = owner[starts]
        # starts close to each other share one region of the text
        for run in np.split(np.arange(len(starts)), np.flatnonzero((np.diff(starts) > 2 * edits + 1) | (np.diff(text) > 0)) + 1):
            t = int(text[run[0]])
            low, high = max(int(starts[run[0]]) - edits, int(first[t])), min(int(starts[run[-1]]) + c.most + edits, int(first[t] + lengths[t]))
            if high > low:
                yield t, c, low - int(first[t]), codes[low:high], starts[run] - low


def window_keys(codes: list[np.ndarray], starts: list[np.ndarray], c: SizeClass) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each repetition: the keys of the windows that start at ``starts`` in each of many code sequences, which of
    the sequences they are in, and the starts. A window may reach beyond its sequence."""
    room = np.zeros(c.size, dtype=np.uint64)
    whole = np.concatenate([x for own in codes for x in (own, room)]) if codes else room
    first = np.cumsum([0] + [len(x) + c.size for x in codes])[:-1]
    owner = np.repeat(np.arange(len(codes)), [len(x) for x in starts])
    at = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    for r in range(c.repetitions):
        yield mix64(walk_keys(whole, at + first[owner], c.size, r) ^ np.uint64(c.size << 32 | r)), owner, at


def best_in(codes: np.ndarray, starts: np.ndarray, item: np.ndarray) -> tuple[int, int] | None:
    """(edit distance, word behind it) of the best match of the item near ``starts`` (ascending); None if none is close enough."""
    edits, best = allowed(len(item)), None
    for run in np.split(starts, np.flatnonzero(np.diff(starts) > 2 * edits + 1) + 1):
        low, high = max(0, int(run[0]) - edits), min(len(codes), int(run[-1]) + len(item) + edits)
        if np.isin(item, codes[low:high]).sum() < len(item) - edits:
            continue  # each word of the item that the region lacks is an edit
        distance, end = edit_distance(item, codes[low:high])
        if distance <= edits:
            best = min(best or (distance, low + end), (distance, low + end))
    return best


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Smallest edit distance of ``item`` to any part of the region, and where the first such part ends."""
    columns = np.arange(len(region) + 1)
    row = np.zeros(len(columns), dtype=np.int64)
    for i, word in enumerate(item):
        new = np.concatenate(([i + 1], np.minimum(row[1:] + 1, row[:-1] + (region != word))))
        row = np.minimum.accumulate(new - columns) + columns
    end = int(row.argmin())
    return int(row[end]), end


def find_in(texts: list[str | None], items: list[np.ndarray], classes: list[SizeClass]) -> list[tuple[int, int, int, int]]:
    """(text, item, edit distance, word at which the match ends) of the best match of each text and item, in one process."""
    of = {(c.size, c.most): c for c in classes}
    own = [(k, x, c) for k, x in enumerate(items) if len(x) and (c := of.get(class_bounds(len(x))))]
    bits = 1 << 20
    flags = np.zeros(bits, dtype=np.uint8)
    table: dict[int, list[int]] = {}
    for k, x, c in own:
        flags[filter_places(x, c.size, bits)] = 1
        for keys, _, _ in window_keys([x], [np.zeros(1, dtype=np.int64)], c):
            table.setdefault(int(keys[0]), []).append(k)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for t, c, offset, codes, starts in regions_in(texts, classes, np.packbits(flags, bitorder="little")):
        met: dict[int, set[int]] = {}
        for keys, _, _ in window_keys([codes], [starts], c):
            for start, key in zip(starts.tolist(), keys.tolist(), strict=True):
                for k in table.get(key, ()):
                    met.setdefault(k, set()).add(start)
        for k, at in met.items():
            if found := best_in(codes, np.array(sorted(at)), items[k]):
                found = (found[0], found[1] + offset)
                best[t, k] = min(best.get((t, k), found), found)
    return [(t, k, d, e) for (t, k), (d, e) in sorted(best.items())]


def item_codes(texts: list[str | None]) -> list[np.ndarray]:
    words = words_of([folded(x) for x in texts], _BREAKS)
    return [words.code[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


_ITEM = "item_id long, n_words long, size int, most int, codes array<long>"
_REGION = "doc_id long, t1 long, t2 long, size int, offset int, codes array<long>, starts array<int>"


def _codes(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64) for x in column]


def _items(benchmark: DataFrame, min_words: int) -> DataFrame:
    """``item_id, n_words, size, most, codes, iid`` of the items that are searched for; equal texts have equal ``iid``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = item_codes(b.column("text").to_pylist())
            yield _arrow([(i, len(c), *class_bounds(len(c)), c.view(np.int64)) for i, c in zip(b.column("item_id").to_pylist(), codes, strict=True) if len(c) >= max(1, min_words)], _ITEM)

    rows = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text")
    return cut_lineage(rows.mapInArrow(run, _ITEM).withColumn("iid", F.xxhash64("codes")))


def _bitmap(distinct: DataFrame, words: int) -> np.ndarray:
    """The bitmap of the items' pairs. It is put together in blocks; the driver gets at most FILTER_BITS of it."""
    bits = min(FILTER_BITS, max(_BLOCK_BITS, 1 << (PAIR_BITS * 2 * words).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [filter_places(c, s, bits) for c, s in zip(_codes(b.column("codes")), b.column("size").to_pylist(), strict=True)]
            at = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // _BLOCK_BITS), pa.array(at % _BLOCK_BITS)], names=["block", "place"])

    def block(group: pa.Table) -> pa.Table:
        flags = np.zeros(_BLOCK_BITS, dtype=np.uint8)
        flags[group["place"].to_numpy()] = 1
        return pa.table({"block": group["block"][:1], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    made = distinct.select("codes", "size").mapInArrow(places, "block long, place long").distinct().groupBy("block").applyInArrow(block, "block long, bits binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in made.collect():
        out[r.block * _BLOCK_BITS // 8 : (r.block + 1) * _BLOCK_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _found(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions of the documents with their ``rid``, ``rid, iid, edit_distance, end`` of the items found in them)."""
    distinct = items.select("iid", "codes", "size", "most").dropDuplicates(["iid"])
    classes = _classes({(r["size"], r.most) for r in items.select("size", "most").distinct().collect()})
    bitmap = _bitmap(distinct, items.agg(F.sum("n_words")).first()[0] or 1)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    of = {c.size: c for c in classes}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            ids = list(zip(*(b.column(c).to_pylist() for c in ("doc_id", "t1", "t2")), strict=True))
            yield _arrow([(*ids[t], c.size, at, codes.view(np.int64), starts) for t, c, at, codes, starts in regions_in(b.column("text").to_pylist(), classes, shared.value)], _REGION)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, 2048):
            sizes, every, starts, rid = b.column("size").to_numpy(), _codes(b.column("codes")), b.column("starts"), b.column("rid").to_numpy()
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                at = [starts[int(i)].values.to_numpy().astype(np.int64) for i in own]
                for keys, owner, start in window_keys([every[i] for i in own], at, of[int(size)]):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(rid[own][owner]), pa.array(start)], names=["key", "rid", "start"])

    def item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, every, iid = b.column("size").to_numpy(), _codes(b.column("codes")), b.column("iid").to_numpy()
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                for keys, _, _ in window_keys([every[i] for i in own], [np.zeros(1, np.int64)] * len(own), of[int(size)]):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(iid[own])], names=["key", "iid"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("rid").to_pylist(), b.column("iid").to_pylist(), b.column("at").to_pylist(), _codes(b.column("codes")), _codes(b.column("item")), strict=True)
            yield _arrow([(rid, iid, *best) for rid, iid, at, codes, item in rows if (best := best_in(codes, np.array(at), item))], "rid long, iid long, edit_distance long, end long")

    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    regions = cut_lineage(texts.mapInArrow(search, _REGION).withColumn("rid", F.xxhash64("size", "codes", "starts")))
    # few bytes make much work: tasks follow the number of regions
    tasks = max(1, min(MOST_TASKS, regions.count() // TASK_REGIONS))
    one = regions.select("rid", "size", "codes", "starts").dropDuplicates(["rid"]).repartition(tasks, "rid")
    keys = distinct.select("iid", "size", "codes").mapInArrow(item_keys, "key long, iid long").distinct()
    windows = one.mapInArrow(keyed, "key long, rid long, start long")
    met = _met(windows, cut_lineage(keys), one, distinct).groupBy("rid", "iid").agg(F.sort_array(F.collect_set("start")).alias("at"))
    pairs = met.join(one.select("rid", "codes"), "rid").join(distinct.select("iid", F.col("codes").alias("item")), "iid")
    return regions, pairs.select("rid", "iid", "at", "codes", "item").mapInArrow(verify, "rid long, iid long, edit_distance long, end long")


def _met(windows: DataFrame, keys: DataFrame, regions: DataFrame, items: DataFrame) -> DataFrame:
    """``rid, iid, start`` of the windows and items that meet on ``key``, less those that cannot match in keys of many items."""
    hot = cut_lineage(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ITEMS))
    if hot.isEmpty():
        return windows.join(keys, "key").select("rid", "iid", "start")
    # the items of a hot key stand as one row until its windows are known
    few = keys.join(hot.select("key"), "key", "left_anti").unionByName(hot.select("key", F.lit(None).cast("long").alias("iid")))
    found = written(windows.join(few, "key"))
    words = keys.join(hot, "key").join(items.select("iid", F.floor(F.size("codes") * EDIT_SHARE + 1e-9).cast("int").alias("edits"), F.array_distinct("codes").alias("codes")), "iid").select("key", "n", "iid", "edits", F.explode("codes").alias("word"))
    common = words.groupBy("key", "word").agg(F.count("*").alias("held"))
    own = words.join(common, ["key", "word"]).groupBy("key", "iid", "edits").agg(F.sort_array(F.collect_list(F.when(F.col("held") * 2 <= F.col("n"), F.struct("held", "word")))).alias("own"))
    # one word more than the edits, the rarest; 0 stands for any text
    enough = F.when(F.size("own") > F.col("edits"), F.transform(F.slice("own", F.lit(1), F.col("edits") + 1), lambda x: x["word"])).otherwise(F.array(F.lit(0).cast("long")))
    marked = own.select("key", "iid", F.explode(enough).alias("word"))
    crowded = found.where("iid is null").select("key", "rid", "start")
    told = crowded.select("key", "rid").distinct().join(regions.select("rid", "codes"), "rid").select("key", "rid", F.explode(F.array_append(F.array_distinct("codes"), F.lit(0).cast("long"))).alias("word"))
    pairs = told.join(marked, ["key", "word"]).select("key", "rid", "iid").distinct()
    return found.where("iid is not null").select("rid", "iid", "start").unionByName(crowded.join(pairs, ["key", "rid"]).select("rid", "iid", "start"))


def matches(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, item_id, n_words, edit_distance, end_word`` for each document and item found in it.

    An item is found where its words are at an edit distance of EDIT_SHARE of their number or less from some
    part of the text; letter case and punctuation do not count. Null and blank texts and items match nothing,
    nor do items under ``min_words`` words. Items under five words allow no edit. Items with equal text all
    match. Rows with equal doc_id are reported each; an empty table on either side gives an empty result.
    Regions and items are told apart by 64-bit hashes of their words.
    """
    items = _items(benchmark, min_words)
    regions, verified = _found(docs, items)
    own = regions.groupBy("doc_id", "t1", "t2", "size", "offset", "rid").agg(F.count("*").alias("copies"))
    best = own.join(verified, "rid").groupBy("doc_id", "t1", "t2", "iid").agg(F.min(F.struct("edit_distance", (F.col("offset") + F.col("end")).alias("end_word"))).alias("m"), F.max("copies").alias("copies"))
    rows = best.join(items.select("iid", "item_id", "n_words"), "iid").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("doc_id", "item_id", "n_words", "m.edit_distance", "m.end_word")


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def clean(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the rows that hold an item, which their texts alone decide; all columns stay, and so do rows
    without text. Texts are told apart by 128 bits of hashes. Those of bad texts are written out, so that Spark knows their
    size and sends them to the documents where they are few."""
    bare = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    regions, verified = _found(bare, _items(benchmark, min_words))
    bad = written(regions.join(verified, "rid").select(F.col("t1").alias("_bad1"), F.col("t2").alias("_bad2")).distinct())
    return docs.join(bad, (F.xxhash64(docs["text"]) == bad["_bad1"]) & (F.xxhash64(F.lit(1), docs["text"]) == bad["_bad2"]), "left_anti")
