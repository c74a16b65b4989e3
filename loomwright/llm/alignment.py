"""Alignment of two tokenizers over a corpus, with dense count matrices striped by the ids of one side.

Both tokenizers cut the same bytes; offsets where tokens of both end cut a text into groups, and the tokens that share a
group are linked. How many documents hold an id pair linked is counted in stripes: stripe s has the rows a of the matrix
with a modulo the number of stripes = s, one dense array that one task fills by ``np.add.at``; its row maxima give the best
partners of each id.

Texts are tokenised once, into a written table of each document's distinct pairs. Documents that stand together form blocks of
a bounded size, and a block sends each of its pairs once, with the number of its documents, so that a pair that nearly every
document has travels once a block. The pairs are scored in the stripe that counts them and return to their blocks,
where each document adds up its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _PLAIN, byte_letters
from .common import byte_values, written

#: Bytes of text in a block (a row counts as some more), of a dense stripe, and pairs that a task scores at most, beside one block's.
BLOCK_BYTES, ROW_BYTES = 16 << 20, 256
STRIPE_BYTES = 64 << 20
TASK_PAIRS = 8 << 20
#: Bytes of text whose tokens are linked at once, and pairs that are written out at once.
_SLICE_BYTES, _SLICE_PAIRS = 1 << 20, 1 << 20
# The public pattern that splits texts before byte-level merges (fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The quicker library looks back over a run of white space, so texts with long ones don't take it.
_RUN = 10_000
_SPACES = re.compile(rf"\s{{{_RUN}}}")


class Tokenizers:
    """A byte-level tokenizer (A) and a piece model (B), and the bytes of their tokens."""

    def __init__(self, spec: str, model: bytes) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.whole.encode_special_tokens = True
        vocab, byte = json.loads(spec)["model"]["vocab"], {x: i for i, x in enumerate(byte_letters())}
        ranks = {bytes(byte[x] for x in name): i for name, i in vocab.items()}
        # the same merges in a quicker library; texts with letters beyond U+02FF, which it may class otherwise, don't take it
        self.quick = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=None, model_proto=model)
        self.bytes_a = [b""] * self.whole.get_vocab_size()
        for name, i in ranks.items():
            self.bytes_a[i] = name
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.sizes = len(self.bytes_a), len(self.bytes_b)
        self.lengths = tuple(np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        # how an id is written in a digest: the second form ends its side of a group
        self.written = [t for i in range(self.sizes[0]) for t in (b"%d," % i, b"%d|" % i)] + [t for i in range(self.sizes[1]) for t in (b"%d," % i, b"%d;" % i)]

    def encode(self, texts: list[bytes | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where the text has none or a side's tokens aren't its bytes with a space before."""
        strings = [(t or b"").decode("utf-8", "replace") for t in texts]
        side_a = [self.ids_a(" " + s) if s else [] for s in strings]
        side_b = self.pieces.encode(strings, num_threads=1)
        for i, (t, a, b) in enumerate(zip(texts, side_a, side_b, strict=True)):
            if not t or b"".join(map(self.bytes_a.__getitem__, a)) != (whole := b" " + t) or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
                side_a[i] = side_b[i] = []
        return side_a, side_b

    def ids_a(self, text: str) -> list[int]:
        if (text.isascii() or _PLAIN.fullmatch(text)) and not (len(text) > _RUN and _SPACES.search(text)):
            return self.quick.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


class Linked:
    """Groups and links of a slice of texts, from the ids of both sides."""

    def __init__(self, tokenizers: Tokenizers, side_a: list[list[int]], side_b: list[list[int]]) -> None:
        self.tokenizers, docs = tokenizers, len(side_a)
        self.n_a, self.n_b = (np.fromiter(map(len, s), np.int64, docs) for s in (side_a, side_b))
        self.a, self.b = (np.fromiter(chain.from_iterable(s), np.int64, n.sum()) for s, n in ((side_a, self.n_a), (side_b, self.n_b)))
        # a text's bytes are the same on both sides, so ends count on from text to text, and texts end together
        ends = [np.cumsum(length[ids]) for ids, length in zip((self.a, self.b), tokenizers.lengths, strict=True)]
        cuts = np.intersect1d(*ends, assume_unique=True)
        self.group_a, self.group_b = (np.searchsorted(cuts, e) for e in ends)
        self.in_a, self.in_b = (np.bincount(g, minlength=len(cuts)) for g in (self.group_a, self.group_b))
        self.doc = np.zeros(len(cuts), dtype=np.int64)
        self.doc[self.group_a] = np.repeat(np.arange(docs), self.n_a)
        self.n_groups, self.n_links = np.bincount(self.doc, minlength=docs), np.zeros(docs, dtype=np.int64)
        np.add.at(self.n_links, self.doc, self.in_a * self.in_b)

    def digests(self) -> list[str]:
        """Of each text with tokens the digest of its groups in order."""
        side = 2 * self.tokenizers.sizes[0]
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (self.group_a, self.group_b))
        codes = np.zeros(len(self.a) + len(self.b), dtype=np.int64)
        codes[np.arange(len(self.a)) + (np.cumsum(self.in_b) - self.in_b)[self.group_a]] = 2 * self.a + last_a
        codes[np.arange(len(self.b)) + np.cumsum(self.in_a)[self.group_b]] = side + 2 * self.b + last_b
        parts = list(map(self.tokenizers.written.__getitem__, codes.tolist()))
        cuts = np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        return [hashlib.sha256(b"".join(parts[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(cuts, cuts[1:], strict=False)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of each text's distinct linked pairs, in order; a pair is a * (ids of B) + b.

        Equal ids of a group are one with a count before the sides meet, so a long group of few ids stays small."""
        size_a, size_b = self.tokenizers.sizes
        key_a, times_a = _summed(self.group_a * size_a + self.a)
        key_b, times_b = _summed(self.group_b * size_b + self.b)
        group_a, id_a, group_b, id_b = key_a // size_a, key_a % size_a, key_b // size_b, key_b % size_b
        first_b, some_b = np.searchsorted(group_b, np.arange(len(self.in_b))), np.bincount(group_b, minlength=len(self.in_b))
        each = some_b[group_a]
        made, step = [], np.cumsum(each) // _SLICE_PAIRS
        for rows in np.split(np.arange(len(key_a)), np.flatnonzero(np.diff(step)) + 1):
            n = each[rows]
            one = np.repeat(rows, n)
            other = np.repeat(first_b[group_a[rows]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            made.append(_summed((self.doc[group_a[one]] * size_a + id_a[one]) * size_b + id_b[other], times_a[one] * times_b[other]))
        key, times = made[0] if len(made) == 1 else _summed(np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]))
        return key // (size_a * size_b), key % (size_a * size_b), times


def _summed(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their times (each one, if not given)."""
    if times is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(times, first) if len(first) else times


_loaded: dict[int, Tokenizers] = {}


def _shared(docs: DataFrame, byte_level: str, piece_model: str) -> Callable[[], Tokenizers]:
    """Both files, read on the driver (a few MB) and sent to the tasks; a worker makes its tokenizers once."""
    with open(byte_level, encoding="utf-8") as f, open(piece_model, "rb") as g:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def load() -> Tokenizers:
        key = hash(sent.value)
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Tokenizers(*sent.value)
        return _loaded[key]

    return load


def _slices(batches: Iterator[pa.RecordBatch], most: int = _SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None], list[int]]]:
    """Rows of a bounded number of bytes (one at least), with their texts and sizes."""
    for b in batches:
        texts = byte_values(b.column("text"))
        sizes = [len(t or b"") + ROW_BYTES for t in texts]
        step = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i), texts[i:j], sizes[i:j]


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.ListArray:  # noqa: B008
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values).cast(kind))


def _flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def linked(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """``block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times`` for every row of ``docs``.

    ``pairs`` are the distinct linked id pairs (a * ids of B + b) and ``times`` how often each is linked. Rows that stand
    together share a block of about BLOCK_BYTES.
    """
    load = _shared(docs, byte_level, piece_model)
    size_a, size_b = load().sizes
    small = size_a * size_b < 2**31  # then pairs fit 32 bits, which halves what is written

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, seen = load(), 0
        for part, texts, sizes in _slices(batches):
            made = Linked(tokenizers, *tokenizers.encode(texts))
            doc, pair, times = made.pairs()
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            block = (np.array(part.column("at")).astype(np.int64) << 32) + seen // BLOCK_BYTES
            seen += sum(sizes)
            columns = [pa.array(block), part.column("doc_id"), *map(pa.array, (made.n_a, made.n_b, made.n_groups, made.n_links)), pa.array(made.digests(), pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, _lists(pair, cuts, pa.int32() if small else pa.int64()), _lists(times, cuts)], names=names)

    kind = "int" if small else "long"
    schema = f"block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, times array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.spark_partition_id().alias("at"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def _stripes(sizes: tuple[int, int]) -> int:
    return max(1, min(sizes[0], -(-sizes[0] * sizes[1] * 8 // STRIPE_BYTES)))


def _sent(links: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """``stripe, block, pairs, docs``: each pair of a block, with the number of its documents that have it, in the stripe of its A id."""
    stripes = _stripes(sizes)

    def pack(block: int, some: list[np.ndarray]) -> pa.RecordBatch:
        pair, docs = np.unique(np.concatenate(some), return_counts=True)
        stripe = pair // sizes[1] % stripes
        order = np.argsort(stripe, kind="stable")
        own = np.unique(stripe)
        cuts = np.searchsorted(stripe[order], np.append(own, stripes))
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), block)), _lists(pair[order], cuts), _lists(docs[order], cuts)], names=["stripe", "block", "pairs", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, some, held = None, [], 0
        for b in batches:
            block = np.array(b.column("block"))
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    if now is not None and (block[i] != now or held > 4 * _SLICE_PAIRS):
                        yield pack(now, some)
                        some, held = [], 0
                    now = int(block[i])
                    some.append(_flat(b.column("pairs").slice(i, j - i)).astype(np.int64))
                    held += len(some[-1])
        if now is not None:
            yield pack(now, some)

    return links.select("block", "pairs").mapInArrow(run, "stripe long, block long, pairs array<long>, docs array<long>")


def _parted(sent: DataFrame, sizes: tuple[int, int]) -> tuple[DataFrame, int]:
    """``sent`` with a ``part``, so many that a part of a stripe has about TASK_PAIRS pairs, beside one block's."""
    pairs = sent.agg(F.sum(F.size("pairs").cast("long"))).first()[0] or 0
    parts = max(1, -(-pairs // _stripes(sizes) // TASK_PAIRS))
    return sent.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts))), parts


def _counted(sent: DataFrame, parts: int, sizes: tuple[int, int]) -> DataFrame:
    """``stripe, pairs, counts, best``: of each pair how many documents have it, and whether that is the most of its A id's.

    Where a stripe has several parts, each of them is summed by a task of its own first."""
    stripes = _stripes(sizes)

    def cells(stripe: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(pairs, counts, whether best) of the cells of a stripe that are not zero, a slice at a time."""
        dense = np.zeros((-(-sizes[0] // stripes), sizes[1]), dtype=np.int64)
        for b in batches:
            pair = _flat(b.column("pairs"))
            np.add.at(dense, (pair // sizes[1] // stripes, pair % sizes[1]), _flat(b.column("docs")))
        most = dense.max(axis=1)
        row, column = np.nonzero(dense)
        for i in range(0, len(row), _SLICE_PAIRS):
            r, c = row[i : i + _SLICE_PAIRS], column[i : i + _SLICE_PAIRS]
            yield (r * stripes + stripe) * sizes[1] + c, dense[r, c], dense[r, c] == most[r]

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, counts, _ in cells(key[0].as_py(), batches):
            cuts = np.array([0, len(pair)])
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), _lists(pair, cuts), _lists(counts, cuts)], names=["stripe", "pairs", "docs"])

    def finish(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, counts, best in cells(key[0].as_py(), batches):
            cuts = np.array([0, len(pair)])
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), _lists(pair, cuts), _lists(counts, cuts), _lists(best, cuts, pa.bool_())], names=["stripe", "pairs", "counts", "best"])

    rows = sent.select("stripe", "part", "pairs", "docs")
    if parts > 1:
        rows = rows.groupBy("stripe", "part").applyInArrow(add, "stripe long, pairs array<long>, docs array<long>")
    return rows.select("stripe", "pairs", "docs").groupBy("stripe").applyInArrow(finish, "stripe long, pairs array<long>, counts array<long>, best array<boolean>")


def _sorted_by_pair(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    pair, counts, best = (_flat(table[c]) for c in ("pairs", "counts", "best"))
    order = np.argsort(pair)
    return pair[order], counts[order], best.astype(bool)[order]


def _scored(sent: DataFrame, counted: DataFrame, parts: int) -> DataFrame:
    """``block, pairs, counts, best``: the pairs of each block, scored where their stripe's counts are."""
    every = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        pair, counts, best = _sorted_by_pair(right)
        own = _flat(left["pairs"]) if len(left) else np.zeros(0, np.int64)
        at = np.searchsorted(pair, own)
        cuts = np.concatenate(([0], np.cumsum(np.array(left["pairs"].combine_chunks().value_lengths() if len(left) else [], dtype=np.int64))))
        return pa.table({"block": left["block"], "pairs": _lists(own, cuts), "counts": _lists(counts[at], cuts), "best": _lists(best[at], cuts, pa.bool_())})

    return sent.select("stripe", "part", "block", "pairs").groupBy("stripe", "part").cogroup(every.groupBy("stripe", "part")).applyInArrow(score, "block long, pairs array<long>, counts array<long>, best array<boolean>")


def align(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    A is the byte-level tokenizer file on a space and the text, B the piece model on the text, both without special tokens.
    A text that is null or empty, or whose tokens on one side aren't its bytes with a space before, has no tokens: all numbers are 0
    and the digest is empty. Every row counts as a document, so repeated rows count each, as do those with one or no doc_id. Ids
    with equally many documents are all best. An empty table gives an empty result.
    """
    links = written(linked(docs, byte_level, piece_model))
    sizes = _shared(docs, byte_level, piece_model)().sizes
    sent, parts = _parted(written(_sent(links, sizes)), sizes)
    back = _scored(sent, written(_counted(sent, parts, sizes)), parts)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        pair, counts, best = _sorted_by_pair(right)
        at = np.searchsorted(pair, _flat(left["pairs"]).astype(np.int64))
        times, doc = _flat(left["times"]), np.repeat(np.arange(len(left)), np.array(left["pairs"].combine_chunks().value_lengths(), dtype=np.int64))
        sums = np.zeros((2, len(left)), dtype=np.int64)
        if len(at):
            np.add.at(sums[0], doc, times * best[at])
            np.add.at(sums[1], doc, times * counts[at])
        return pa.table({c: left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": left["groups_sha256"]})

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return links.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(add, schema)


def pair_counts(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """``a, b, documents, best`` for every id pair that some document has linked."""
    sizes = _shared(docs, byte_level, piece_model)().sizes
    counted = _counted(*_parted(written(_sent(linked(docs, byte_level, piece_model), sizes)), sizes), sizes)
    rows = counted.select(F.explode(F.arrays_zip("pairs", "counts", "best")).alias("p"))
    return rows.select(F.expr(f"p.pairs div {sizes[1]}").cast("int").alias("a"), (F.col("p.pairs") % sizes[1]).cast("int").alias("b"), F.col("p.counts").alias("documents"), F.col("p.best").alias("best"))


def aligned_groups(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """``doc_id, groups`` for every row of ``docs``: its groups in order, each with the ids ``a`` and ``b`` of both sides."""
    load = _shared(docs, byte_level, piece_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = load()
        for part, texts, _ in _slices(batches):
            made = Linked(tokenizers, *tokenizers.encode(texts))
            sides = [_lists(ids, np.concatenate(([0], np.cumsum(n))), pa.int32()) for ids, n in ((made.a, made.in_a), (made.b, made.in_b))]
            groups = pa.StructArray.from_arrays(sides, names=["a", "b"])
            cuts = np.concatenate(([0], np.cumsum(made.n_groups))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts), groups)], names=["doc_id", "groups"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")
