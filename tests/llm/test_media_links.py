"""Links between pictures: recall over pairs, at every distance, in crowds, and for turned and rescaled copies."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwright.llm import media


def words(bits):
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def turned(pixels, degrees):
    """Bilinear rotation about the centre."""
    h, w = pixels.shape
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    y, x = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    xs, ys = np.clip(c * x + s * y + (w - 1) / 2, 0, w - 1.001), np.clip(c * y - s * x + (h - 1) / 2, 0, h - 1.001)
    x0, y0 = xs.astype(int), ys.astype(int)
    fx, fy = xs - x0, ys - y0
    return (pixels[y0, x0] * (1 - fx) + pixels[y0, x0 + 1] * fx) * (1 - fy) + (pixels[y0 + 1, x0] * (1 - fx) + pixels[y0 + 1, x0 + 1] * fx) * fy


def squares(seed, size=12):
    return np.kron(np.random.Generator(np.random.PCG64(seed)).integers(0, 16, (size, size)) * 17.0, np.ones((8, 8)))


EDITS = {
    "crop": lambda p: p[3:80, 5:90] * 0.8 + 30, "quarter": np.rot90, "half": lambda p: np.rot90(p, 2), "two degrees": lambda p: turned(p, 2), "four degrees": lambda p: turned(p, 4), "eight degrees": lambda p: turned(p, 8),
    "nine tenths": lambda p: media.resized(p, 0.9), "larger": lambda p: media.resized(p, 1.15), "smaller": lambda p: media.resized(p, 0.85), "blurred twice": lambda p: media._box(media._box(p, 1), 1),
    "four thirds": lambda p: media.resized(p, 4 / 3), "three quarters": lambda p: media.resized(p, 0.75), "noise": lambda p: p + np.random.Generator(np.random.PCG64(1)).normal(0, 3, p.shape),
}


@pytest.fixture(scope="module")
def album():
    pictures, origin = [], []
    for k in range(36):
        for edit in [lambda p: p, *(EDITS[e] for e in list(EDITS)[k % 13 :: 5])]:
            pictures.append(media.write_pgm(np.asarray(edit(squares(k).astype(np.float32)))))
            origin.append(k)
    return pictures, origin


def test_recall_over_all_pairs(spark, album):
    pictures, origin = album
    local = [media.described(media.read_pgm(x)) for x in pictures]
    linked = set()
    for i, (place, bits) in enumerate(local):
        for j in range(i):
            a, b = np.nonzero(np.bitwise_count(words(bits)[:, None] ^ words(local[j][1])[None]).sum(2) <= media.MOST_BITS)
            if len(a) >= media.LEAST_CORNERS and media.agree(media.packed_places(place)[a], media.packed_places(local[j][0])[b]):
                linked.add((j, i))
    got = {r.media_id: r.class_id for r in media.copies(spark.createDataFrame(list(enumerate(pictures)), "media_id long, image binary")).collect()}
    true = [(a, b) for a in range(len(origin)) for b in range(a + 1, len(origin)) if origin[a] == origin[b]]
    assert len(linked) > 60
    assert np.mean([got[a] == got[b] for a, b in linked]) >= 0.9  # against every pair of pictures
    assert np.mean([got[a] == got[b] for a, b in true]) >= 0.9  # against the edits that were made
    assert all(origin[k] == origin[got[k]] for k in got)


@pytest.mark.parametrize("edit", EDITS)
def test_each_edit_agrees(edit):
    found = 0
    for k in range(100, 112):
        one, two = (media.described(media.read_pgm(media.write_pgm(np.asarray(f(squares(k).astype(np.float32)))))) for f in (lambda p: p, EDITS[edit]))
        a, b = np.nonzero(np.bitwise_count(words(one[1])[:, None] ^ words(two[1])[None]).sum(2) <= media.MOST_BITS)
        found += media.agree(media.packed_places(one[0])[a], media.packed_places(two[0])[b])
    assert found >= 11


@pytest.mark.parametrize("crowd", [0, 40])
def test_descriptors_meet_at_every_distance(spark, crowd, monkeypatch):
    """Pairs at each distance up to MOST_BITS, alone and in entries with many other members, are found and found once."""
    rng = np.random.Generator(np.random.PCG64(crowd))
    monkeypatch.setattr(media, "TILE", 16)
    rows, pairs = [], {}
    for distance in range(media.MEET_BITS + 1):
        for _ in range(60):
            base = rng.integers(0, 2, media.TESTS, dtype=np.uint8)
            other = base.copy()
            other[rng.choice(media.TESTS, distance, replace=False)] ^= 1
            pairs[len(rows), len(rows) + 1] = distance
            rows += [base, other]
            if distance % 6 == 3:
                for _ in range(crowd // 8):
                    far = base.copy()
                    far[rng.choice(media.TESTS, 30, replace=False)] ^= 1
                    rows.append(far)
    bits, tables = media.tables_for(len(rows))
    w = words(np.array(rows)).view(np.int64)
    each = spark.createDataFrame(pa.table({"id": range(len(rows)), "d": range(len(rows)), "at": [0] * len(rows), **{f"w{i}": w[:, i] for i in range(w.shape[1])}}).to_pandas())
    members = media.entries(each, bits, tables).join(each, "d").withColumn("comp", F.col("id")).withColumn("rank", F.col("id")).withColumn("tile", F.lit(0).cast("long")).withColumn("side", F.lit(0).cast("byte"))
    found = [(r.a, r.b) for r in media._compared(members, 4, media.table_masks(bits, tables), True).collect()]
    assert len(found) == len(set(found))
    hits = {d: np.mean([p in set(found) for p, e in pairs.items() if e == d]) for d in set(pairs.values())}
    assert hits[0] == 1 and min(hits.values()) >= 0.8 and np.mean(list(hits.values())) >= 0.9


def test_an_entry_of_many_loses_no_link(spark, monkeypatch):
    """One picture in many edits, and strangers, with entries cut into tiny tiles: the classes stay the same."""
    pictures = []
    for k in range(3):
        base = squares(200 + k).astype(np.float32)
        pictures += [media.write_pgm(base[i % 5 : 90 + i % 4, i // 5 : 88 + i % 3] * (0.7 + i / 100) + i) for i in range(22)]
    table = spark.createDataFrame(list(enumerate(pictures)), "media_id long, image binary")
    whole = {r.media_id: r.class_id for r in media.copies(table).collect()}
    monkeypatch.setattr(media, "CROWD", 3)
    monkeypatch.setattr(media, "TILE", 4)
    assert {r.media_id: r.class_id for r in media.copies(table).collect()} == whole == {i: i // 22 * 22 for i in range(66)}


def test_few_true_matches_among_many():
    """Three matches that agree are found among thousands that do not."""
    rng = np.random.Generator(np.random.PCG64(5))
    random = lambda n: np.column_stack((rng.uniform(0, 4000, n), rng.uniform(0, 4000, n), rng.integers(0, len(media.SCALES), n), rng.uniform(0, 2 * np.pi, n)))
    one, two = random(2000), random(2000)
    assert not media.agree(media.packed_places(one[:40]), media.packed_places(two[:40]))
    true = np.array([[100.0, 200.0, 0, 0.3], [400.0, 90.0, 0, 1.3], [250.0, 700.0, 0, 2.3]])
    order = rng.permutation(2003)
    a, b = np.concatenate((one, true))[order], np.concatenate((two, true + [30, -20, 0, 0]))[order]
    assert media.agree(media.packed_places(a), media.packed_places(b))


def test_headers_of_pictures():
    pixels = np.arange(6, dtype=np.uint8).reshape(2, 3)
    assert (media.read_pgm(b"P5 3 2 255\n" + pixels.tobytes()) == pixels).all()
    assert (media.read_pgm(b"P5\n# made by hand\n3 2\n255\n" + pixels.tobytes()) == pixels).all()
    assert (media.read_pgm(b"P5 3 2 5\n" + pixels.tobytes()) == pixels * np.float32(51)).all()
    assert (media.read_pgm(b"P5 3 2 65535\n" + (pixels.astype(">u2") * 257).tobytes()) == pixels).all()
    for bad in (None, b"", b"P5 3 2 255\n123", b"P6 1 1 255\nx", b"P5 0 0 255\n"):
        assert media.read_pgm(bad) is None


def shuffled(spark):
    return sum(e.totalShuffleWrite() for e in spark.sparkContext._gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))


def test_descriptors_travel_by_family(spark):
    """What is shuffled stays within some times the descriptors' 40 bytes: they travel for each family of tables, not for each table."""
    table = media.written(media.pictures(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")))
    count = sum(len(media.described(media.read_pgm(bytes(r.image)))[0]) for r in table.collect())
    before = shuffled(spark)
    assert media.copies(table).count() == 500
    assert shuffled(spark) - before < 6 * 40 * count


@pytest.fixture(scope="module")
def brute_classes(album):
    """The smallest picture reachable over the links that a comparison of all descriptors finds."""
    local = [media.described(media.read_pgm(x)) for x in album[0]]
    least = list(range(len(local)))
    for i, (place, bits) in enumerate(local):
        for j in range(i):
            a, b = np.nonzero(np.bitwise_count(words(bits)[:, None] ^ words(local[j][1])[None]).sum(2) <= media.MOST_BITS)
            if len(a) >= media.LEAST_CORNERS and media.agree(media.packed_places(place)[a], media.packed_places(local[j][0])[b]):
                least = [min(least[i], least[j]) if x in (least[i], least[j]) else x for x in least]
    return least


@pytest.mark.parametrize("hot", [10**9, 40, 1])
def test_routes_lose_no_copies(spark, album, brute_classes, monkeypatch, hot):
    """Short routes in several families, ordinary ones, some and all of them too hot for a task: copies are found as before."""
    monkeypatch.setattr(media, "ROUTED", 64)
    monkeypatch.setattr(media, "HOT", hot)
    pictures, origin = album
    got = {r.media_id: r.class_id for r in media.copies(spark.createDataFrame(list(enumerate(pictures)), "media_id long, image binary")).collect()}
    true = [(a, b) for a in range(len(origin)) for b in range(a + 1, len(origin)) if origin[a] == origin[b]]
    assert np.mean([got[a] == got[b] for a, b in true]) >= 0.9
    assert all(brute_classes[k] == brute_classes[got[k]] for k in got)


@pytest.mark.parametrize("count", [0, 1500, 33_000, 333_000, 1_660_000, 10**8, 10**10])
def test_families_keep_the_recall(count):
    """The share of pairs at MEET_BITS that meet in a table, drawn at random, at any number of descriptors."""
    (bits, tables), (route, families) = media.tables_for(count), media.routes_for(count)
    masks = media.table_masks(bits, tables, route, families)
    assert masks.shape == (tables, media.TESTS // 64) and tables % families == 0 and (np.bitwise_count(masks).sum(axis=1) == bits).all()
    assert all(np.bitwise_count(np.bitwise_and.reduce(own)).sum() >= route for own in np.split(masks, families))
    assert count / 2**route <= media.ROUTED or count <= media.ROUTED
    rng = np.random.Generator(np.random.PCG64(count))
    differ = np.zeros((4000, media.TESTS), dtype=np.uint8)
    np.put_along_axis(differ, rng.random(differ.shape).argsort(axis=1)[:, : media.MEET_BITS], 1, axis=1)
    meet = ((words(differ)[:, None] & masks[None]) == 0).all(axis=2).any(axis=1)
    assert meet.mean() >= media.RECALL - 0.03
