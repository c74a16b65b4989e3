"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The symbols of a word are the leaves' places: leaf i holds the rank of the pair that starts at symbol i (none: infinity)
with i behind it, so the tree's root is the lowest rank and, of equal ranks, the leftmost place. A merge changes three
leaves (the pair itself, the one before it, and the merged symbol's, which goes), each a path to the root. The word is
done when the root is infinite. Short words are merged many at a time, one tree a row; long ones have a tree of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int64(2**62)
#: Bytes up to which words share an array of trees; cells of such an array; words kept by a worker, and letters of the longest of those.
SHORT, CELLS = 64, 1 << 21
KEPT_WORDS, KEPT_LETTERS = 1 << 18, 64
_SLICE_BYTES = 4 << 20
#: Texts of these code points need neither composition nor rules of lower case that differ between libraries.
_PLAIN = re.compile("[\0-˿]*")


@cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 characters for themselves, the
    others in turn from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """The merges of a byte-level vocabulary with word ends, and the splitting that comes before them.

    ``spec`` is the JSON text of a tokenizer file: its normaliser and split pattern are used through the tokenizers library
    (texts without letters beyond U+02FF take an equal, quicker way); the merges are made here.
    """

    def __init__(self, spec: str) -> None:
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        whole = json.loads(spec)
        model = whole["model"]
        split, level = whole["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or whole["decoder"]:
            raise ValueError("the file is no plain byte-level BPE with word ends")
        if (split["behavior"], split["invert"], level["type"], level["use_regex"], level["add_prefix_space"]) != ("Removed", True, "ByteLevel", False, False):
            raise ValueError("the file splits texts in a way that is not known")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in whole["added_tokens"]):
            raise ValueError("the file has added tokens of a kind that is not known")
        pattern = split["pattern"]["Regex"]
        self.normalizer, self.split = Tokenizer.from_str(spec).normalizer, Split(Regex(pattern), "removed", invert=True)
        # the same pattern for plain texts, with their few letters and digits written out
        small = sorted({x for c in range(0x300) for x in chr(c).lower()})
        for name in ("L", "N"):
            own = regex.compile(rf"\p{{{name}}}")
            pattern = pattern.replace(rf"\p{{{name}}}", "".join(re.escape(c) for c in small if own.match(c)))
        self.words = re.compile(pattern.replace(r"\s", "\t-\r \x85\xa0"))
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.inner = np.array([vocab[x] for x in byte_letters()])
        self.last = np.array([vocab[x + end] for x in byte_letters()])
        self.size = np.int64(len(self.names))
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        first, second, self.made = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        order = np.argsort(first * self.size + second)
        self.keys, self.ranks = (first * self.size + second)[order], order.astype(np.int64)
        self.rank_of = {(a, b): r for r, (a, b, _) in enumerate(pairs)}
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, bytes] = {}

    def ranked(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaves: rank and place of each pair in one number, NONE where it has no merge (or a symbol is -1)."""
        key = np.where((a | b) < 0, -1, a * self.size + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at] << 32 | place, NONE)

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of at most as many bytes as the longest, rounded up to a power of two, in one array of trees."""
        width = 1 << (max(map(len, words)) - 1).bit_length()
        size = np.array([len(x) for x in words])
        # one more column, which stands before and behind the word, holds no symbol
        symbol = np.full((len(words), width + 1), -1, dtype=np.int64)
        symbol[:, :width][np.arange(width) < size[:, None]] = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        symbol[np.arange(len(words)), size - 1] = self.last[[x[-1] for x in words]]
        after = np.tile(np.append(np.arange(1, width + 1), width), len(words))
        before = np.tile(np.arange(-1, width) % (width + 1), len(words))
        tree = np.empty((len(words), 2 * width), dtype=np.int64)
        tree[:, width:] = self.ranked(symbol[:, :-1], symbol[:, 1:], np.arange(width))
        for level in range(width.bit_length() - 2, -1, -1):
            low = 1 << level
            np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2], out=tree[:, low : 2 * low])
        tree, flat = tree.ravel(), symbol.ravel()
        rows = np.arange(len(words))
        while True:
            root = tree[rows * (2 * width) + 1]
            live = np.flatnonzero(root < NONE)
            if not len(live):
                break
            rows, root = rows[live], root[live]
            row, leaf = rows * (width + 1), rows * (2 * width) + width
            i, new = root & 0xFFFFFFFF, self.made[root >> 32]
            j, p = after[row + i], before[row + i]
            k = after[row + j]
            flat[row + i], flat[row + j] = new, -1
            after[row + i], before[row + k] = k, i
            # where nothing stands before, its leaf is the merged symbol's own, written once more behind
            behind = self.ranked(flat[row + p], new, p)
            p = np.where(p == width, i, p)
            tree[leaf + p] = behind
            tree[leaf + i] = self.ranked(new, flat[row + k], i)
            tree[leaf + j] = NONE
            top, node = np.tile(leaf - width, 3), np.concatenate((p, i, j)) + width
            for _ in range(width.bit_length() - 1):
                node >>= 1
                child = top + 2 * node
                tree[top + node] = np.minimum(tree[child], tree[child + 1])
        symbol = symbol[:, :-1]
        there = symbol >= 0
        cuts = np.cumsum(there.sum(axis=1))
        flat = symbol[there].tolist()
        return [flat[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def merge_long(self, word: bytes) -> list[int]:
        """The same for one word of any length."""
        n, none = len(word), int(NONE)
        symbol = self.inner[np.frombuffer(word, np.uint8)].tolist()
        symbol[-1] = int(self.last[word[-1]])
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        width = 1 << (n - 1).bit_length()
        leaf = lambda i, j: none if i < 0 or j < 0 or (r := self.rank_of.get((symbol[i], symbol[j]))) is None else r << 32 | i
        tree = [none] * (2 * width)
        tree[width : width + n] = [leaf(i, after[i]) for i in range(n)]
        for x in range(width - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def put(i: int, value: int) -> None:
            x = i + width
            tree[x] = value
            while x > 1:
                x >>= 1
                value = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == value:
                    return
                tree[x] = value

        made = self.made.tolist()
        while (root := tree[1]) < none:
            i = root & 0xFFFFFFFF
            j = after[i]
            k, p = after[j], before[i]
            symbol[i], symbol[j], after[i] = made[root >> 32], -1, k
            if k >= 0:
                before[k] = i
            put(j, none)
            put(i, leaf(i, k))
            if p >= 0:
                put(p, leaf(p, i))
        return [s for s in symbol if s >= 0]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self.merge_long(w)
            else:
                classes.setdefault((len(w) - 1).bit_length(), []).append(i)
        for bits, some in classes.items():
            step = max(1, CELLS >> bits + 1)
            for at in range(0, len(some), step):
                part = some[at : at + step]
                for i, ids in zip(part, self.merge_short([words[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens, and special tokens."""
        if self.cut is None or not self.cut.search(text):
            return self._split(text)
        out = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self._split(part)
        return out

    def _split(self, text: str) -> list[str]:
        if text.isascii() or _PLAIN.fullmatch(text):
            return self.words.findall(text.lower())
        return [w for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def packed(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Of each text: its ids as little-endian 32-bit numbers, and the decoded text in UTF-8."""
        every = [self.pieces(t) if t else [] for t in texts]
        if len(self.ids) > KEPT_WORDS:
            self.ids.clear()
            self.texts.clear()
        new = set().union(*every) - self.ids.keys()
        rest = [w for w in new if w not in self.special]
        for words, made in (([w for w in new if w in self.special], [[self.special[w]] for w in new if w in self.special]), (rest, self.merge([w.encode() for w in rest]))):
            flat, cuts = np.array([i for ids in made for i in ids], dtype="<u4").tobytes(), np.cumsum([0, *(4 * len(ids) for ids in made)]).tolist()
            self.ids.update(zip(words, [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
            self.texts.update(zip(words, [self.decode(ids).encode() for ids in made], strict=True))
        for ws in every:
            yield b"".join(map(self.ids.__getitem__, ws)), b" ".join(map(self.texts.__getitem__, ws))
        for w in new:  # very long words are not kept
            if len(w) > KEPT_LETTERS:
                del self.ids[w], self.texts[w]

    def decode(self, ids: list[int]) -> str:
        """Names of the tokens with a space between them: a file without decoder says no more of how they join."""
        return " ".join([self.names[i] for i in ids])


_loaded: dict[str, Merges] = {}


def _loaded_from(spec: str) -> Merges:
    """One object for each file in a worker."""
    if spec not in _loaded:
        _loaded.clear()
        _loaded[spec] = Merges(spec)
    return _loaded[spec]


def _mapped(docs: DataFrame, vocabulary: str, finish: Callable[[bytes, bytes], tuple], schema: str) -> DataFrame:
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _loaded_from(shared.value)
        kinds = None
        for b in batches:
            kinds = kinds or pa.schema([b.schema.field("doc_id"), *_kinds(schema)])
            sizes = np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0)), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(sizes // _SLICE_BYTES)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                part = b.slice(low, high - low)
                rows = [finish(*x) for x in merges.packed(part.column("text").to_pylist())]
                columns = [pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), list(kinds)[1:], strict=True)] if rows else [pa.array([], k.type) for k in list(kinds)[1:]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def _kinds(schema: str) -> list[pa.Field]:
    known = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return [pa.field(n, known[k]) for n, k in (c.split() for c in schema.split(", ")[1:])]


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs``: the ids of the whole text, without special tokens added.

    ``vocabulary`` is the path of a tokenizer file, read on the driver and sent to the tasks (a few MB). Special tokens that
    stand in a text get their ids. Null, empty and blank texts have no ids. Repeated rows are all returned; an empty table
    gives an empty result. Work is row by row, and a word of n bytes takes n log n steps.
    """
    return _mapped(docs, vocabulary, lambda ids, _: (np.frombuffer(ids, "<i4"),), "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` for every row of ``tokens`` (``doc_id, ids``): null ids give a null text, no ids an empty one."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _loaded_from(shared.value)
        for b in batches:
            texts = [None if x is None else merges.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``: how many ids its text has, and the digests of
    the ids (little-endian unsigned 32-bit numbers) and of what they decode to. Odd input as for ``encoded``: a text without
    ids has the digests of nothing."""
    return _mapped(docs, vocabulary, lambda ids, text: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
