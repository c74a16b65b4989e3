"""Copies among pictures by local descriptors.

Corners are found at several scales; each gets the direction of its patch's centre of mass and a row of
binary tests (which of two points is brighter) turned by that direction. Descriptors meet in tables: the key of
a table is a seeded sample of the test bits, and so many tables are taken that two descriptors at MEET_BITS
differing bits share one with the stated recall. Those that meet are compared on all bits. Two pictures are
copies when several of their matching corners agree on one turn, scale and shift.

The tables of a family share some of their bits, so a descriptor travels once for each family and not for each
table: to the task of its route, the value of the shared bits. There the family's tables are made and the members
of an entry compared. Routes with too many descriptors for a task are dealt by the keys of their tables instead.

Every pair that meets counts, however many members a table entry has. In crowded entries each member is first
compared with one centre, in a few rounds of differently dealt tiles, which ties the pictures of a true group
together in linear time. Then all pairs of members that are not yet of one class are compared, tile against
tile, so that one entry's work is spread over many tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut_lineage, mix64, written

#: Steps so close that a copy at a size between two of them still meets one of its own.
SCALES = (1.0, 0.87, 0.75, 0.65, 0.5625)
RADIUS = 15
TESTS = 192
#: Differing bits at most, corners that must agree at least, and pixels of tolerance.
MOST_BITS, LEAST_CORNERS, TOLERANCE = 24, 3, 3
#: Share of the descriptor pairs at MEET_BITS that meet in a table. Farther ones up to MOST_BITS count wherever they meet; three of a
#: picture's many corners are enough.
RECALL, MEET_BITS = 0.9, 12
#: A corner is the strongest within so many pixels.
PEAK = 3
#: Members of an entry from which centres come first, and members of a tile.
CROWD, TILE = 64, 512
#: Descriptors of a route in the mean, and from how many on it is dealt by keys. Share of the pairs at MEET_BITS that share a route.
ROUTED, HOT, REACH = 32_768, 262_144, 0.94
#: Rows of a task that compares.
PART_ROWS = 100_000
PICTURES_PER_TASK = 4096
#: Pixels that are described side by side, and that wait for others of their size.
BESIDE, WAITING = 1 << 17, 1 << 21

_RNG = np.random.Generator(np.random.PCG64(11))
_POINTS = np.clip(_RNG.normal(0, RADIUS / 2, (TESTS, 2, 2)), -RADIUS + 3, RADIUS - 3)
_WORDS = TESTS // 64
_HEADER_PART = re.compile(rb"(?:\s|#[^\n]*\n)+(\d{1,6})")


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM picture as 0 to 255; None if it is not one. Comments in the header are passed over."""
    if data is None or not data.startswith(b"P5"):
        return None
    numbers, at = [], 2
    while len(numbers) < 3:
        m = _HEADER_PART.match(data, at)
        if m is None:
            return None
        numbers.append(int(m[1]))
        at = m.end()
    width, height, most = numbers
    depth = 1 if most < 256 else 2
    if not (width and height and 0 < most < 65536) or len(data) < at + 1 + width * height * depth:
        return None
    pixels = np.frombuffer(data, np.uint8 if depth == 1 else ">u2", width * height, at + 1)
    return pixels.reshape(height, width).astype(np.float32) * np.float32(255 / most)


def write_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def resized(pixels: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear resampling. Like all of this, of one picture or of pictures of one size, one beside the other in the last axis."""
    if scale == 1.0:
        return pixels
    out = pixels
    for axis in (0, 1):
        n = max(1, round(out.shape[axis] * scale))
        at = np.clip((np.arange(n) + 0.5) / scale - 0.5, 0, out.shape[axis] - 1)
        low = np.minimum(at.astype(int), max(0, out.shape[axis] - 2))
        part = (at - low).astype(np.float32)
        part = part.reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, out.shape[axis] - 1), axis) * part
    return out


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of 2 r + 1, by running sums."""
    for axis in (0, 1):
        x = np.moveaxis(x, axis, 0)
        n = len(x)
        pad = np.clip(np.arange(-r - 1, n + r), 0, n - 1)
        if x[0].size < 512:
            total = np.cumsum(x[pad], 0, dtype=np.float64)
        else:  # a row at a time is quicker than running sums of each column
            total = np.empty((len(pad), *x.shape[1:]))
            total[0] = x[0]
            for i in range(1, len(pad)):
                np.add(total[i - 1], x[pad[i]], out=total[i])
        x = np.moveaxis((total[2 * r + 1 :] - total[:n]) / (2 * r + 1), 0, axis)
    return x


def corners(pixels: np.ndarray) -> np.ndarray:
    """(row, column) of all corners that a patch fits around: local peaks of the structure tensor's strength."""
    return _corners(pixels[:, :, None])[:, 1:]


def _corners(pixels: np.ndarray) -> np.ndarray:
    """(picture, row, column) of pictures of one size."""
    height, width, count = pixels.shape
    if min(height, width) < 2 * RADIUS + 3:
        return np.zeros((0, 3), dtype=int)
    gy, gx = np.gradient(pixels, axis=(0, 1))
    a, b, c = (x.reshape(height, width, count) for x in np.split(_box(np.concatenate((gx * gx, gx * gy, gy * gy), axis=2), 2), 3, axis=2))
    strength = a * c - b * b - 0.05 * (a + c) ** 2
    # where a patch fits nothing beyond the border is near
    at = RADIUS + 1
    peak = strength[at - PEAK : height - at + PEAK, at - PEAK : width - at + PEAK]
    peak = np.maximum.reduce([peak[i : i + height - 2 * at] for i in range(2 * PEAK + 1)])
    peak = np.maximum.reduce([peak[:, i : i + width - 2 * at] for i in range(2 * PEAK + 1)])
    own = strength[at : height - at, at : width - at]
    return np.argwhere(((own >= peak) & (own > 1.0)).transpose(2, 0, 1)) + (0, at, at)


def describe(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each corner: (x, y, scale number) in the pixels of the whole picture, and its test bits."""
    places, bits = described(pixels)
    return places[:, :3], bits


def described(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each corner: (x, y, scale number, direction), and its test bits."""
    return described_all([pixels])[0]


def described_all(pictures: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same of several pictures; those of one size are described side by side."""
    by_size: dict[tuple[int, ...], list[int]] = {}
    for i, pixels in enumerate(pictures):
        by_size.setdefault(pixels.shape, []).append(i)
    out: list = [None] * len(pictures)
    for (height, width), own in by_size.items():
        step = max(1, BESIDE // (height * width))
        for k in range(0, len(own), step):
            some = own[k : k + step]
            places, bits, of = _described(np.stack([pictures[i] for i in some], axis=2))
            for i, first, last in zip(some, np.searchsorted(of, range(len(some))), np.searchsorted(of, range(1, len(some) + 1)), strict=True):
                out[i] = places[first:last], bits[first:last]
    return out


def _described(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, bits and numbers of their pictures, of pictures of one size."""
    places, bits, of = [np.zeros((0, 4))], [np.zeros((0, TESTS), bool)], [np.zeros(0, int)]
    d = np.arange(-RADIUS, RADIUS + 1)
    disc = d[:, None] ** 2 + d[None, :] ** 2 <= RADIUS**2
    x, y = _POINTS[None, :, :, 0], _POINTS[None, :, :, 1]
    for number, scale in enumerate(SCALES):
        level = resized(pixels, scale)
        height, width = level.shape[:2]
        found = _corners(level)
        if not len(found):
            continue
        smooth = np.ascontiguousarray(_box(_box(level, 1), 1).transpose(2, 0, 1)).reshape(-1)
        near = d[:, None] * width + d[None, :]
        for i in range(0, len(found), 1024):
            at = found[i : i + 1024]
            patch = smooth[(((at[:, 0] * height) + at[:, 1]) * width + at[:, 2])[:, None, None] + near] * disc
            angle = np.arctan2((patch * d[None, :, None]).sum((1, 2)), (patch * d[None, None, :]).sum((1, 2)))
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            col = np.clip(np.rint(at[:, 2, None, None] + cos * x - sin * y).astype(int), 0, width - 1)
            row = np.clip(np.rint(at[:, 1, None, None] + sin * x + cos * y).astype(int), 0, height - 1)
            value = smooth[(at[:, 0, None, None] * height + row) * width + col]
            bits.append(value[:, :, 0] < value[:, :, 1])
            places.append(np.column_stack(((at[:, 2] + 0.5) / scale - 0.5, (at[:, 1] + 0.5) / scale - 0.5, np.full(len(at), number), angle)))
            of.append(at[:, 0])
    order = np.argsort(np.concatenate(of), kind="stable")
    return np.concatenate(places)[order], np.concatenate(bits)[order], np.concatenate(of)[order]


# A corner's place packed into a long: x and y in half pixels, scale number, direction in 4096ths of a turn.
def packed_places(place: np.ndarray) -> np.ndarray:
    x, y = (np.clip(np.rint(place[:, i] * 2), 0, 2**20 - 1).astype(np.int64) for i in (0, 1))
    turn = np.rint(place[:, 3] / (2 * np.pi) * 4096).astype(np.int64) % 4096
    return ((x << 20 | y) << 4 | place[:, 2].astype(np.int64)) << 12 | turn


def unpacked_places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place as a complex number, scale, direction)."""
    scale = np.array(SCALES)[(at >> 12) & 15]
    return (at >> 36) / 2 + 1j * ((at >> 16 & 0xFFFFF) / 2), scale, (at & 4095) * (2 * np.pi / 4096)


def _spared(bits: int, fixed: int = 0) -> float:
    """Chance that none of MEET_BITS differing bits is among ``bits`` sampled ones, given that ``fixed`` others spared them."""
    return math.prod((TESTS - fixed - MEET_BITS - i) / (TESTS - fixed - i) for i in range(bits))


def routes_for(count: int) -> tuple[int, int]:
    """(bits that a family's tables share, number of families): routes keep their size as descriptors grow."""
    route = max(0, math.ceil(math.log2(max(1, count) / ROUTED)))
    return route, math.ceil(math.log(1 - REACH) / math.log(1 - _spared(route))) if route else 1


def tables_for(count: int) -> tuple[int, int]:
    """(bits of a key, number of tables): keys grow with the number of descriptors, so that strangers seldom meet."""
    bits = min(64, max(20, math.ceil(math.log2(max(2, count))) + 9))
    route, families = routes_for(count)
    reached, meets = _spared(route), _spared(bits - route, route)
    # a family misses a pair that does not share its route, or none of its tables
    missed = ((1 - RECALL) ** (1 / families) - (1 - reached)) / reached
    return bits, families * math.ceil(math.log(missed) / math.log(1 - meets))


def table_masks(bits: int, tables: int, route: int = 0, families: int = 1) -> np.ndarray:
    """The sampled bits of each table, as words; those of a family share ``route`` of them."""
    rng = np.random.Generator(np.random.PCG64(bits))
    chosen = np.zeros((tables, TESTS), dtype=np.uint8)
    for own in np.split(chosen, families):
        own[:, rng.choice(TESTS, route, replace=False)] = 1
        for table in own:
            table[rng.choice(np.flatnonzero(table == 0), bits - route, replace=False)] = 1
    return np.packbits(chosen, axis=1, bitorder="little").view("<u8")


def keys(words: np.ndarray, mask: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Code of the masked bits of each descriptor (columns of ``words``)."""
    key = np.broadcast_to(mix64(seed.astype(np.uint64)), words.shape[1:])
    for w, m in zip(words, mask, strict=True):
        key = mix64(key ^ (w & m))
    return key


def _cells(at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What matches vote on: steps of scale and twelfths of a turn."""
    _, sa, da = unpacked_places(at_a)
    _, sb, db = unpacked_places(at_b)
    return np.rint(np.log(sb / sa) * 100).astype(int), np.floor(np.mod(da - db, 2 * np.pi) / (2 * np.pi / 12)).astype(int) % 12


def hopeful(pair: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Whether ``agree`` can be true of the matches of each pair (its number with each match, in order from zero): that takes LEAST_CORNERS
    votes for one cell and its neighbours, and as many places in both pictures. No pair that agrees is left out."""
    if not len(pair):
        return np.zeros(0, dtype=bool)
    count = int(pair[-1]) + 1
    size, cell = _cells(at_a, at_b)
    row = (pair * (np.ptp(size) + 1) + size - size.min()) * 12
    filled, held = np.unique(row + cell, return_counts=True)
    votes = np.zeros(len(pair), dtype=int)
    for d in (-1, 0, 1):
        look = row + (cell + d) % 12
        at = np.minimum(np.searchsorted(filled, look), len(filled) - 1)
        votes += np.where(filled[at] == look, held[at], 0)
    out = np.zeros(count, dtype=bool)
    out[pair[votes >= LEAST_CORNERS]] = True
    for at in (at_a, at_b):
        x, y = (np.rint(v / 8).astype(np.int64) for v in (at >> 36, at >> 16 & 0xFFFFF))
        place = x << 20 | y
        order = np.lexsort((place, pair))
        new = np.concatenate(([True], (place[order[1:]] != place[order[:-1]]) | (pair[order[1:]] != pair[order[:-1]])))
        out &= np.bincount(pair[order[new]], minlength=count) >= LEAST_CORNERS
    return out


def agree(at_a: np.ndarray, at_b: np.ndarray) -> bool:
    """Whether LEAST_CORNERS matches or more, of as many places in both pictures, agree on one turn, scale and shift.

    Matches vote on (turn, scale) first; every match whose cell and its neighbours hold enough of them is tried, those of
    the fullest cells before others."""
    za, sa, da = unpacked_places(at_a)
    zb, sb, db = unpacked_places(at_b)
    turn, ratio = np.exp(1j * (da - db)), sb / sa
    size, cell = _cells(at_a, at_b)
    _, size = np.unique(size, return_inverse=True)
    held = np.zeros((size.max(initial=0) + 1, 12), dtype=int)
    np.add.at(held, (size, cell), 1)
    votes = (held + np.roll(held, 1, axis=1) + np.roll(held, -1, axis=1))[size, cell]
    for i in np.argsort(-votes, kind="stable")[: int((votes >= LEAST_CORNERS).sum())]:
        step = turn[i] * ratio[i]
        # a match alone knows its turn to some degrees; together with another, which it draws in, it knows more
        near = np.abs(za - za[i] - step * (zb - zb[i])) <= TOLERANCE + 0.15 * np.abs(za - za[i])
        near &= (np.abs(turn / turn[i] - 1) < 0.4) & (np.abs(ratio / ratio[i] - 1) < 0.01)
        drawn = np.flatnonzero(near)
        from_a, from_b = za[drawn] - za[i], zb[drawn] - zb[i]
        best = np.zeros(0, dtype=int)
        for k in np.array_split(np.flatnonzero(np.abs(from_b) >= TOLERANCE), 1 + len(drawn) // 256):
            fits = np.abs(from_a - (from_a[k] / from_b[k])[:, None] * from_b) <= TOLERANCE
            if len(k) and fits.sum(axis=1).max() > len(best):
                best = drawn[fits[fits.sum(axis=1).argmax()]]
        near = np.isin(np.arange(len(za)), best)
        for _ in range(2):
            if near.sum() < LEAST_CORNERS:
                break
            ma, mb = za[near].mean(), zb[near].mean()
            spread = (np.abs(zb[near] - mb) ** 2).sum()
            if spread < LEAST_CORNERS * 9:
                near[:] = False
                break
            step = ((za[near] - ma) * np.conj(zb[near] - mb)).sum() / spread
            good = (np.abs(za - ma - step * (zb - mb)) <= TOLERANCE) & (np.abs(turn * np.abs(step) / step - 1) < 0.4) & (np.abs(ratio / np.abs(step) - 1) < 0.3)
            near = good
        if near.sum() >= LEAST_CORNERS and min(len(np.unique(np.rint(z[near] / 4))) for z in (za, zb)) >= LEAST_CORNERS:
            return True
    return False


_LOCAL = "media_id long, content long, at array<long>, " + ", ".join(f"w{i} array<long>" for i in range(_WORDS))
_MATCH = "a long, b long, at_a long, at_b long"
_MET = "key long, members long, id long, at long, " + ", ".join(f"w{i} long" for i in range(_WORDS)) + ", " + _MATCH
_FAMILIES = 64


def features(media: DataFrame) -> DataFrame:
    """Content hash and local descriptors of each picture; their bits are words of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, columns, waiting, held = [], [[] for _ in range(1 + _WORDS)], [], 0
            for row, data in enumerate(b.column("image").to_pylist(), 1):
                pixels = read_pgm(data)
                waiting.append(pixels)
                held += 0 if pixels is None else pixels.size
                content.append(None if data is None else xxhash.xxh64_intdigest(data) - 2**63)
                if held < WAITING and row < b.num_rows:
                    continue
                known = iter(described_all([pixels for pixels in waiting if pixels is not None]))
                for pixels in waiting:
                    place, bits = next(known) if pixels is not None else (np.zeros((0, 4)), np.zeros((0, TESTS), bool))
                    words = np.packbits(bits, axis=1, bitorder="little").view("<i8") if len(bits) else np.zeros((0, _WORDS), np.int64)
                    for column, values in zip(columns, (packed_places(place), *words.T), strict=True):
                        column.append(values)
                waiting, held = [], 0
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("media_id"), pa.array(content, pa.int64()), *(pa.array(c, lists) for c in columns)], names=[c.split()[0] for c in _LOCAL.split(", ")])

    return media.select(F.col("media_id").cast("long"), "image").mapInArrow(run, _LOCAL)


def _stacked(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([rows.column(f"w{i}").to_numpy().view(np.uint64) for i in range(_WORDS)])


def entries(each: DataFrame, bits: int, tables: int, route: int = 0, families: int = 1) -> DataFrame:
    """``key, d`` for each descriptor (``d, w0..``) and table; where there is a ``part``, for each table of its family."""
    masks, dealt = table_masks(bits, tables, route, families), "part" in each.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, d = _stacked(b), b.column("d").to_numpy()
            family = b.column("part").to_numpy() % _FAMILIES if dealt else None
            for t in range(tables):
                own = slice(None) if family is None else family == t * families // tables
                key = keys(words[:, own], masks[t], np.array([t]))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(d[own])], names=["key", "d"])

    return each.select("d", *(f"w{i}" for i in range(_WORDS)), *(["part"] if dealt else [])).mapInArrow(run, "key long, d long")


def _routed(each: DataFrame, masks: np.ndarray, families: int, columns: list[str]) -> DataFrame:
    """``part`` and the named columns of each descriptor, for each family; ``part`` is its route, with the family's number as remainder."""
    shared = [np.bitwise_and.reduce(own) for own in np.split(masks, families)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _stacked(b)
            for f, mask in enumerate(shared):
                part = keys(words, mask, np.array([f])) // np.uint64(2 * _FAMILIES) * np.uint64(_FAMILIES) + np.uint64(f)
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), *(b.column(c) for c in columns)], names=["part", *columns])

    return each.select("id", "at", *(f"w{i}" for i in range(_WORDS))).mapInArrow(run, ", ".join(f"{c} long" for c in ["part", *columns]))


def _near(words: np.ndarray, i: np.ndarray, j: np.ndarray, key: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the descriptor pairs those within MOST_BITS whose first table in which they meet is that of ``key``: it alone reports them."""
    differ = words[:, i] ^ words[:, j]
    keep = np.bitwise_count(differ).sum(axis=0, dtype=np.int64) <= MOST_BITS
    i, j, differ = i[keep], j[keep], differ[:, keep]
    if not len(i):
        return i, j
    first = ((differ[None, :, :] & masks[:, :, None]) == 0).all(axis=1).argmax(axis=0)
    keep = keys(words[:, i], masks[first].T, first).view(np.int64) == key[i]
    return i[keep], j[keep]


def _pairs(run_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within runs of equal values, by their distance."""
    for d in range(1, int(np.bincount(run_of).max(initial=1)) if len(run_of) else 1):
        i = np.flatnonzero(run_of[d:] == run_of[:-d])
        yield i, i + d


def _matched(ids: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
    swap = ids[i] > ids[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return {"a": ids[i], "b": ids[j], "at_a": at[i], "at_b": at[j]}


def _met(routed: DataFrame, masks: np.ndarray, families: int) -> DataFrame:
    """The family's tables of each route: descriptor pairs of unlike pictures within MOST_BITS (``a, b, at_a, at_b``), each of
    them once in all tables, from entries of at most CROWD members; of larger ones the members (``key, members, id, at, w0..``)."""
    crowd, per = CROWD, len(masks) // families

    def run(group: pa.Table) -> pa.Table:
        first = int(group["part"][0].as_py()) % _FAMILIES * per
        words, ids, at = _stacked(group), group["id"].to_numpy(), group["at"].to_numpy()
        rows, pairs, schema = [], [np.zeros((2, 0), np.int64)], pa.schema([(c.split()[0], pa.int64()) for c in _MET.split(", ")])
        for t in range(first, first + per):
            key = keys(words, masks[t], np.array([t])).view(np.int64)
            order = np.argsort(key, kind="stable")
            run_of = np.cumsum(np.concatenate(([False], key[order[1:]] != key[order[:-1]])))
            begin = np.flatnonzero(np.concatenate(([True], run_of[1:] != run_of[:-1])))
            unlike = (np.minimum.reduceat(ids[order], begin) != np.maximum.reduceat(ids[order], begin))[run_of]
            members = np.bincount(run_of)[run_of]
            many = unlike & (members > crowd)
            if many.any():
                d = order[many]
                named = {"key": key[d], "members": members[many], "id": ids[d], "at": at[d], **{f"w{i}": w[d].view(np.int64) for i, w in enumerate(words)}}
                rows.append(pa.table({c: pa.array(named[c]) if c in named else pa.nulls(len(d), pa.int64()) for c in schema.names}))
            few = unlike & (members <= crowd)
            d = order[few]
            for i, j in _pairs(run_of[few]):
                i, j = d[i], d[j]
                differ = ids[i] != ids[j]
                pairs.append(np.stack(_near(words, i[differ], j[differ], key, masks)))
        named = _matched(ids, at, *np.concatenate(pairs, axis=1))
        rows.append(pa.table({c: pa.array(named[c]) if c in named else pa.nulls(len(named["a"]), pa.int64()) for c in schema.names}))
        return pa.concat_tables(rows).cast(schema)

    return routed.groupBy("part").applyInArrow(run, _MET)


def _compared(members: DataFrame, parts: int, masks: np.ndarray, every: bool) -> DataFrame:
    """Descriptor pairs of unlike classes within MOST_BITS, each of them once in all tables.

    ``members`` has ``key, tile, side, id, comp, rank, at, w0..``. With ``every`` all pairs of a (key, tile) are
    compared, of two sides those across; else all others with the one that has the smallest rank.
    """

    def run(group: pa.Table) -> pa.Table:
        key, tile, rank = (group[c].to_numpy() for c in ("key", "tile", "rank"))
        order = np.lexsort((rank, tile, key))
        key, tile = key[order], tile[order]
        ids, comp, side, at = (group[c].to_numpy()[order] for c in ("id", "comp", "side", "at"))
        words = _stacked(group)[:, order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])))
        run_of = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        two_sided = np.zeros(len(begin), dtype=bool)
        np.logical_or.at(two_sided, run_of, side > 0)
        out = [np.zeros((2, 0), np.int64)]
        others = np.flatnonzero(~new)
        for i, j in _pairs(run_of) if every else [(begin[run_of[others]], others)]:
            keep = (comp[i] != comp[j]) & (~two_sided[run_of[i]] | (side[i] != side[j]))
            out.append(np.stack(_near(words, i[keep], j[keep], key, masks)))
        return pa.table(_matched(ids, at, *np.concatenate(out, axis=1)))

    return members.groupBy(F.pmod(F.xxhash64("key", "tile"), F.lit(parts)).alias("part")).applyInArrow(run, _MATCH)


def _links(matches: DataFrame, parts: int) -> DataFrame:
    """``a, b`` of the pictures whose matching corners agree; pairs without a ``fresh`` match have been judged before."""

    def run(group: pa.Table) -> pa.Table:
        a, b, at_a, at_b = (group[c].to_numpy() for c in ("a", "b", "at_a", "at_b"))
        order = np.lexsort((at_b, at_a, b, a))
        a, b, at_a, at_b = a[order], b[order], at_a[order], at_b[order]
        fresh = group["fresh"].to_numpy()[order]
        pair = np.cumsum(np.concatenate(([False], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))[: len(a)]
        keep = ((np.bincount(pair, fresh) > 0) & (np.bincount(pair) >= LEAST_CORNERS))[pair]
        a, b, at_a, at_b = a[keep], b[keep], at_a[keep], at_b[keep]
        _, pair = np.unique(pair[keep], return_inverse=True)
        keep = hopeful(pair, at_a, at_b)[pair]
        a, b, at_a, at_b = a[keep], b[keep], at_a[keep], at_b[keep]
        cuts = np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [len(a)]))
        good = [i for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i and agree(at_a[i:j], at_b[i:j])]
        return pa.table({"a": a[good], "b": b[good]})

    return matches.groupBy(F.pmod(F.xxhash64("a", "b"), F.lit(parts)).alias("part")).applyInArrow(run, "a long, b long")


def _each(known: DataFrame) -> DataFrame:
    """A row for each descriptor of ``id, at, w0..`` (lists)."""
    columns = ["at", *(f"w{i}" for i in range(_WORDS))]
    return known.select("id", F.explode(F.arrays_zip(*columns)).alias("c")).select("id", "c.*")


def copies(media: DataFrame) -> DataFrame:
    """``media_id, class_id, n_corners`` for every row of ``media`` (``media_id, image``).

    ``class_id`` is the smallest media_id reachable over links; equal bytes are always linked. Null pictures,
    and bytes that are no picture, have no corners; null ones link nothing and are their own class. A row
    without media_id has a null class. Repeated rows are all returned; an empty table gives an empty result.
    """
    local = written(features(media))
    known = local.where("media_id is not null and content is not null")
    columns = ["at", *(f"w{i}" for i in range(_WORDS))]
    one = written(known.groupBy("content").agg(F.min(F.struct("media_id", *columns)).alias("r")).select("content", "r.*"))
    each = _each(one.select(F.col("media_id").alias("id"), *columns))
    count = each.count()
    (bits, tables), (route, families) = tables_for(count), routes_for(count)
    masks = table_masks(bits, tables, route, families)
    whole = ["id", *columns]
    routed = _routed(each, masks, families, whole)
    hot = cut_lineage(_routed(each, masks, families, []).groupBy("part").agg(F.count("*").alias("members")).where(F.col("members") > HOT).select("part"))
    full = not hot.isEmpty()
    met = written(_met(routed.join(hot, "part", "left_anti") if full else routed, masks, families))
    shared = met.where("key is not null").select("key", "members", *whole)
    if full:  # keys alone are matched first; only descriptors that share one travel with their bits
        apart = routed.join(hot, "part", "left_semi").withColumn("d", F.xxhash64("id", "at"))
        slim = entries(apart, bits, tables, route, families)
        counts = slim.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        slim = slim.join(counts.hint("merge"), "key")
        shared = shared.unionByName(written(slim.join(each.withColumn("d", F.xxhash64("id", "at")).hint("merge"), "d").select(*shared.columns)))
    size = shared.agg(F.count("*").alias("rows"), F.max("members").alias("most")).first()
    parts = max(8, (size.rows + met.where("key is null").count()) // PART_ROWS)
    # for crowds, a round of centres for each power of TILE that the largest entry holds
    rounds = 0 if (size.most or 0) <= CROWD else max(1, math.ceil(math.log(size.most) / math.log(TILE)))
    links, classes = None, None
    for turn in range(rounds + 1):
        now = shared if turn == rounds else shared.where(F.col("members") > CROWD)
        if classes is None:
            now = now.withColumn("comp", F.col("id"))
        else:
            now = now.join(classes, F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "id"))
        now = now.withColumn("d", F.xxhash64("id", "at")).withColumn("rank", F.lit(0).cast("long") if turn == rounds else F.xxhash64("id", F.lit(turn)))
        if turn == rounds:  # of crowded entries only those of several classes are left; they are compared tile against tile
            if rounds:
                mixed = now.where(F.col("members") > CROWD).groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low = high").select("key")
                now = now.join(mixed.hint("merge"), "key", "left_anti")
            tiles = F.ceil(F.col("members") / TILE).cast("long")
            now = now.withColumn("tiles", tiles).withColumn("own", F.pmod(F.col("d"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
            low, high = F.least("own", "other"), F.greatest("own", "other")
            now = now.withColumn("tile", low * F.col("tiles") + high).withColumn("side", F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2).cast("byte"))
        else:
            tiles = F.greatest(F.lit(1).cast("long"), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("members") / TILE))).cast("long"))
            now = now.withColumn("tile", F.pmod(F.xxhash64("id", F.lit(-1 - turn)), tiles)).withColumn("side", F.lit(0).cast("byte"))
        matches = _compared(now.select("key", "tile", "side", "id", "comp", "rank", *columns), parts, masks, turn == rounds)
        matches = matches.withColumn("fresh", F.lit(True))
        if turn in (0, rounds):  # with those of the other entries: they tie many before the last turn, and a picture's corners may meet in either
            matches = matches.unionByName(met.where("key is null").select("a", "b", "at_a", "at_b", F.lit(turn == 0).alias("fresh")))
        found = _links(matches, parts)
        links = cut_lineage(found if links is None else found.unionByName(links))
        classes = connected_components(links)
    found = one.select("content", F.col("media_id").alias("node")).join(classes, "node", "left")
    found = found.select(F.col("content").alias("same"), F.coalesce("component", "node").alias("component"))
    return local.select("media_id", "content", F.size("at").cast("long").alias("n_corners")).join(found, F.col("content") == F.col("same"), "left").select(
        "media_id",
        F.when(F.col("media_id").isNotNull(), F.coalesce("component", "media_id")).alias("class_id"),
        "n_corners",
    )


def pictures(vectors: DataFrame) -> DataFrame:
    """``media_id, image``: a picture for each row of ``vec_id, embedding``, for want of a table of pictures.

    The values become an eight by eight field of grey squares. Every eighth picture is instead an edited copy
    of the picture seven ids before: cropped, brightened and with less contrast.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for vec_id, own, other in zip(*(b.column(c).to_pylist() for c in ("vec_id", "embedding", "other")), strict=True):
                vector = np.array([v for v in (other or own or []) if v is not None], dtype=float)
                if not len(vector):
                    made.append(None)
                    continue
                field = np.resize(vector, 64).reshape(8, 8)
                spread = np.abs(field).max() or 1.0
                pixels = np.kron(np.round((field / spread + 1) * 7.5) * 17, np.ones((8, 8)))
                if other is not None:
                    top, left = vec_id // 8 % 4, vec_id // 32 % 5
                    pixels = pixels[top : 60 + top % 3, left : 59 + left % 4] * 0.8 + 30
                made.append(write_pgm(pixels))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(made, pa.binary())], names=["media_id", "image"])

    # a picture is much work for few bytes: tasks are cut by rows
    tasks = max(8, vectors.count() // PICTURES_PER_TASK)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").repartition(tasks, "vec_id")
    source = rows.where("vec_id % 8 = 0").select((F.col("vec_id") + 7).alias("copy_id"), F.col("embedding").alias("other")).repartition(tasks, "copy_id")
    return rows.join(source, F.col("vec_id") == F.col("copy_id"), "left").select("vec_id", "embedding", "other").mapInArrow(draw, "media_id long, image binary")
