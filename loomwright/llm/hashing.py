"""Hashes of words and of word windows over a whole block of texts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from xxhash import xxh3_128_digest

from .common import mix64

#: Bytes that separate words: space and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Words of a block of texts: 128-bit codes in two lanes, and where each text's words begin."""

    lanes: np.ndarray  # two rows
    first: np.ndarray  # of each text, with one more entry at the end

    @property
    def code(self) -> np.ndarray:
        """The first lane: 64 bits of each word."""
        return self.lanes[0]

    @property
    def text(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int, lane: int = 0) -> np.ndarray:
        """Code of the window that starts at each word; meaningless where it would leave its text.

        Windows are put together from halves, each time through a mixing function of both, so no relation among word codes
        carries over to windows (as it does to sums of powers)."""
        own = self.lanes[lane]
        out, length = None, 0
        part, width = own, 1
        while True:
            if size & width:
                out = part if out is None else _joined(out, _ahead(part, length))
                length += width
            if length == size:
                return out
            part = _joined(part, _ahead(part, width))
            width *= 2

    def fits(self, size: int) -> np.ndarray:
        """Whether a window of ``size`` words that starts here stays in its text."""
        return np.arange(len(self.code)) + size <= np.repeat(self.first[1:], np.diff(self.first))


def _ahead(codes: np.ndarray, n: int) -> np.ndarray:
    """The codes ``n`` places further on, zero behind the end."""
    out = np.zeros_like(codes)
    out[: max(0, len(codes) - n)] = codes[n:]
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(left) * _STEP + right)


@cache
def _breaks(flags: bytes) -> bytes:
    if not all(flags[b] for b in SPACES):
        raise ValueError("white space separates words in any case")
    return bytes(32 if f else b for b, f in enumerate(flags))


def words_of(texts: list[bytes | None], is_space: np.ndarray = _IS_SPACE) -> Words:
    """Word codes of every text, whole: of each word the two halves of its XXH3 hash of 128 bits. ``is_space`` has a flag for each
    byte value that separates words; those of white space must be set."""
    table = None if is_space is _IS_SPACE else _breaks(is_space.astype(np.uint8).tobytes())
    digests, counts = [], []
    for text in texts:
        words = ((text.translate(table) if table else text).split()) if text else []
        digests.append(b"".join(map(xxh3_128_digest, words)))
        counts.append(len(words))
    lanes = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2).T
    return Words(np.ascontiguousarray(lanes.astype(np.uint64)), np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int64))
