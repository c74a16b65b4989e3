"""Removal of repeated word sequences, found by difference-cover anchors.

A difference cover D modulo P holds, for every shift, two members that differ by it. So whatever the
positions i and j of two equal windows of W words, some offset below P puts both i + offset and
j + offset on cover positions, and the equal windows share an anchor of W - P + 1 words there. Only
anchors at cover positions are hashed and compared (5 of 21 positions for W = 35).

The texts are dealt into blocks. Each block sends each anchor code once (with a mark if it has it
twice), packed by code range, so a passage that a third of all documents share travels once per block.
Codes that repeat return to their blocks, where every window around such an anchor is a candidate. The
candidates' own codes take the same way, which extends each shared anchor to the windows that really
repeat. The texts are shuffled once; Spark reuses that exchange for the three passes.

Words have codes of 128 bits (XXH3), and so have candidate windows, put together from their words' codes without a relation that
sequences of few words could use; 64 bits of them deal codes out, and only windows equal in all 128 count. Anchors
have 64 bits: a wrong one costs a needless candidate, never a word. Among n candidates about n * n / 2**129 pairs of
different windows are expected to be taken for equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values
from .hashing import Words, words_of

WINDOW = 35
#: Bytes of text in a block, tasks at most (each has a block or few), and bytes of text for each range of codes. Both grow with the
#: root of the input beyond ROOT_BYTES, up to the second figure, so that a block has several codes of a range at any size.
BLOCK_BYTES, MOST_BLOCK_BYTES = 4 << 20, 32 << 20
MOST_TASKS = 1 << 17
RANGE_BYTES, MOST_RANGE_BYTES = 8 << 20, 256 << 20
ROOT_BYTES = 50 << 30
# Perfect difference sets by their period (fixed values).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18), 31: (1, 5, 11, 24, 25, 27)}

_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_SENT = "part long, block long, once array<long>, more array<long>"
_CHECKED = _SENT + ", once_check array<long>, more_check array<long>"


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor length): the sparsest cover that leaves anchors of 12 words or more, else the longest anchors."""
    fitting = [p for p in COVERS if window - p + 1 >= 12] or ([3] if window >= 3 else [])
    if not fitting:
        return 1, (0,), window
    period = max(fitting)
    return period, COVERS[period], window - period + 1


def anchors(words: Words, window: int) -> np.ndarray:
    """Positions of the anchors: cover positions of each text, where an anchor fits."""
    period, cover, length = cover_for(window)
    within = (np.arange(len(words.code)) - np.repeat(words.first[:-1], np.diff(words.first))) % period
    return np.flatnonzero(np.isin(within, cover) & words.fits(length))


def cuts_for(size: int) -> tuple[int, int]:
    """(blocks, ranges of codes) for so many bytes of text."""
    grown = max(1.0, (size / ROOT_BYTES) ** 0.5)
    return max(8, int(size / min(MOST_BLOCK_BYTES, BLOCK_BYTES * grown))), max(16, int(size / min(MOST_RANGE_BYTES, RANGE_BYTES * grown)))


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.view(np.int64)))


def _runs(code: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(order by code and check, whether a new code begins at each place of that order)."""
    order = np.argsort(code, kind="stable") if check is None else np.lexsort((check, code))
    code = code[order]
    new = np.concatenate(([True], code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
    if check is not None and len(code):
        check = check[order]
        new[1:] |= check[1:] != check[:-1]
    return order, new


def _packed(codes: np.ndarray, block: int, ranges: int, check: np.ndarray | None = None) -> pa.Table:
    """One row for each range that the block has codes of: those that it has once, and those that it has more often, with
    their further 64 bits if given. The work follows the codes, not the number of ranges."""
    order, new = _runs(codes, check)
    count = np.diff(np.append(np.flatnonzero(new), len(new)))
    codes, check = codes[order][new], None if check is None else check[order][new]
    part = ((codes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    parts = part[np.diff(part, prepend=-1) > 0]
    columns = {"part": pa.array(parts), "block": pa.array(np.full(len(parts), block))}
    for name, own in (("once", count == 1), ("more", count > 1)):
        cuts = np.append(np.searchsorted(part[own], parts), own.sum())
        columns[name] = _lists(codes[own], cuts)
        if check is not None:
            columns[f"{name}_check"] = _lists(check[own], cuts)
    return pa.table(columns).select([n for n in ("part", "block", "once", "more", "once_check", "more_check") if n in columns])


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64) if len(column) else np.zeros(0, np.uint64)


def _repeated(group: pa.Table) -> pa.Table:
    """Of one range of codes: to each block its codes that are elsewhere too, or that it has more than once."""
    checked = "once_check" in group.column_names
    lengths = [np.array(group[name].combine_chunks().value_lengths(), dtype=np.int64) for name in ("once", "more")]
    code = np.concatenate([_flat(group[name]) for name in ("once", "more")])
    check = np.concatenate([_flat(group[f"{name}_check"]) for name in ("once", "more")]) if checked else None
    row = np.concatenate([np.repeat(np.arange(len(group)), n) for n in lengths])
    twice = np.arange(len(code)) >= lengths[0].sum()
    order, new = _runs(code, check)
    run = np.cumsum(new) - 1
    keep = ((np.bincount(run) > 1) | (np.bincount(run, twice[order]) > 0))[run] if len(run) else new
    order = order[keep]
    order = order[np.argsort(row[order], kind="stable")]
    cuts = np.searchsorted(row[order], np.arange(len(group) + 1))
    columns = {"block": group["block"], "codes": _lists(code[order], cuts)} | ({"checks": _lists(check[order], cuts)} if checked else {})
    return pa.table(columns).filter(pa.array(np.diff(cuts) > 0))


def _among(code: np.ndarray, check: np.ndarray, known: np.ndarray, known_check: np.ndarray) -> np.ndarray:
    """Whether each pair (code, check) is among the known ones."""
    out = np.isin(code, known)
    some = np.flatnonzero(out)
    both = np.concatenate((code[some], known)), np.concatenate((check[some], known_check))
    order, new = _runs(*both)
    run = np.cumsum(new) - 1
    is_known = np.bincount(run, order >= len(some)) > 0 if len(run) else new
    hit = np.zeros(len(order), dtype=bool)
    hit[order] = is_known[run]
    out[some] = hit[: len(some)]
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``.

    Each word covered by a window of ``window`` words that starts anywhere else too is removed; windows
    are judged on the input. Null and blank texts have no words and the digest of the empty string. Texts
    under ``window`` words lose none. Rows with equal or null doc_id count as separate documents; an
    empty table gives an empty result. Texts are taken whole. Equal rows of one input partition share a block.
    """
    return _passes(docs, window, _digest, _OUT)


def kept_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, kept_text``: each text's remaining words joined by one space."""
    return _passes(docs, window, lambda words, mask: b" ".join(compress(words, mask)).decode(), "doc_id long, kept_text string")


def _digest(words: list[bytes], mask: np.ndarray) -> tuple:
    kept = b" ".join(words if mask.all() else compress(words, mask))
    return len(words), int(len(words) - mask.sum()), hashlib.sha256(kept).hexdigest()


def _passes(docs: DataFrame, window: int, finish, schema: str) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length("text").cast("decimal(38,0)"))).first()[0] or 0
    blocks, ranges = cuts_for(int(size))
    # tasks have as many bytes at every size that MOST_TASKS can serve, and always work a block at a time; rows that are
    # equal go to as many blocks as they come from partitions
    tasks = min(blocks, MOST_TASKS)
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).alias("block")).repartition(tasks, "block")
    period, _, length = cover_for(window)

    def first(group: pa.Table) -> pa.Table:
        words = words_of(byte_values(group["text"]))
        return _packed(words.windows(length)[anchors(words, window)], group["block"][0].as_py(), ranges)

    def candidates(words: Words, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a shared anchor."""
        at = anchors(words, window)
        near = np.zeros(len(words.code) + period + 1, dtype=np.int64)
        near[at[np.isin(words.windows(length)[at], shared)] + 1] = 1
        near = np.cumsum(near)
        return np.flatnonzero((near[period : period + len(words.code)] > near[: len(words.code)]) & words.fits(window))

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        words = words_of(byte_values(left["text"]))
        starts = candidates(words, _flat(right["codes"]))
        return _packed(words.windows(window)[starts], left["block"][0].as_py(), ranges, words.windows(window, 1)[starts])

    def third(left: pa.Table, right: pa.Table) -> pa.Table:
        values = byte_values(left["text"])
        words = words_of(values)
        shared = _flat(right["codes"])
        cover = np.zeros(len(words.code) + 1, dtype=np.int64)
        if len(shared):
            starts = np.flatnonzero(words.fits(window))
            starts = starts[_among(words.windows(window)[starts], words.windows(window, 1)[starts], shared, _flat(right["checks"]))]
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + window, -1)
        keep = np.cumsum(cover)[:-1] == 0
        rows = []
        for i, value in enumerate(values):
            made = finish((value or b"").split(), keep[words.first[i] : words.first[i + 1]])
            rows.append(made if isinstance(made, tuple) else (made,))
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.Table.from_arrays([left["doc_id"].combine_chunks(), *(pa.array(list(c)) for c in zip(*rows, strict=True))], names=names)

    def shared(sent: DataFrame) -> DataFrame:
        checks = ", checks array<long>" if "once_check" in sent.columns else ""
        return sent.groupBy("part").applyInArrow(_repeated, "block long, codes array<long>" + checks)

    by_block = texts.groupBy("block")
    found = shared(by_block.applyInArrow(first, _SENT)).repartition(tasks, "block")
    found = shared(by_block.cogroup(found.groupBy("block")).applyInArrow(second, _CHECKED)).repartition(tasks, "block")
    return by_block.cogroup(found.groupBy("block")).applyInArrow(third, schema)
