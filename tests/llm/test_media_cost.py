"""What op8 does for each picture and each candidate pair: pictures of one size side by side, hopeless pairs all at once."""

import numpy as np

from loomwright.llm import media


def squares(seed, height=64, width=64):
    field = np.random.default_rng(seed).integers(0, 16, (-(-height // 8), -(-width // 8))) * 17
    return np.kron(field, np.ones((8, 8)))[:height, :width].astype(np.float32)


def test_pictures_side_by_side_have_the_descriptors_of_each_alone(monkeypatch):
    album = [squares(k, *size) for k in range(12) for size in ((64, 64), (60, 59), (64, 60), (20, 20), (33, 90))]
    monkeypatch.setattr(media, "BESIDE", 5 * 64 * 64)  # several, and some left over
    sides = media.described_all(album)
    for pixels, (places, bits) in zip(album, sides, strict=True):
        own_places, own_bits = media.described(pixels)
        assert np.array_equal(places, own_places) and np.array_equal(bits, own_bits)
    assert sum(len(places) for places, _ in sides) > 500


def matches(rng, kind, n):
    """Places of ``n`` matches: of one consensus, of any places, or at one place of the first picture."""
    a = np.column_stack((rng.uniform(20, 400, (n, 2)), rng.integers(0, 3, n), rng.uniform(0, 6, n)))
    b = a + [30, 40, 0, 0]
    if kind == "any":
        b = np.column_stack((rng.uniform(20, 400, (n, 2)), rng.integers(0, 5, n), rng.uniform(0, 6, n)))
    if kind == "one place":
        a[:, :2] = [100, 100]
        b[:, 3] = a[:, 3] = 1.0
    return media.packed_places(a), media.packed_places(b)


def test_no_pair_that_agrees_is_left_out():
    rng = np.random.default_rng(3)
    made = [matches(rng, kind, n) for n in (1, 2, 3, 4, 7, 30) for kind in ("consensus", "any", "one place") for _ in range(20)]
    pair = np.repeat(np.arange(len(made)), [len(a) for a, _ in made])
    hope = media.hopeful(pair, *(np.concatenate(x) for x in zip(*made, strict=True)))
    good = np.array([len(a) >= media.LEAST_CORNERS and media.agree(a, b) for a, b in made])
    assert hope[good].all() and good.sum() >= 80
    assert not hope[np.array([len(a) < 3 for a, _ in made])].any()


def test_matches_at_one_place_are_not_tried_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(2 * k, 2 * k + 1, int(x), int(y), True) for k in range(40) for x, y in zip(*matches(rng, "one place" if k else "consensus", 5), strict=True)]
    table = spark.createDataFrame(rows, "a long, b long, at_a long, at_b long, fresh boolean").coalesce(1)
    least = media.LEAST_CORNERS

    def once(at_a, at_b):  # stands for agree in the tasks
        if len({int(x) >> 16 for x in at_a}) < least:
            raise AssertionError("tried")
        return True

    monkeypatch.setattr(media, "agree", once)
    group = {}
    monkeypatch.setattr(type(table.groupBy()), "applyInArrow", lambda self, run, schema: group.setdefault("run", run))
    media._links(table, 1)
    assert group["run"](table.toArrow()).to_pydict() == {"a": [0], "b": [1]}
    assert group["run"](table.where("a > 0").toArrow()).num_rows == 0
