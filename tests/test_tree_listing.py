"""Listings of a tree's stream: the driver holds a part of one, tasks read the names."""

import pickle
import tracemalloc
from collections import Counter

from loomwright.sources import bundle


def reader(root, state, **more):
    return bundle._TreeStream({"path": str(root), "state": str(state)} | more)


def given(stream, start, end):
    """What the tasks of a batch read, with their number."""
    parts = [pickle.loads(pickle.dumps(p)) for p in stream.partitions({"listing": start}, {"listing": end})]
    rows = [r for p in parts for b in stream.read(p) for r in zip(*(b.column(c).to_pylist() for c in ("bundle", "rel_path", "content")), strict=True)]
    return Counter(rows), len(parts)


def test_the_driver_does_not_hold_a_listing(tmp_path):
    root = tmp_path / "t"
    for i in range(200):
        (root / f"d{i}").mkdir(parents=True)
        for k in range(100):
            (root / f"d{i}" / f"a name of some length {k}.md").touch()
    stream = reader(root, tmp_path / "state")
    tracemalloc.start()
    assert stream.latestOffset() == {"listing": 1} and stream.latestOffset() == {"listing": 1}
    parts = stream.partitions({"listing": 0}, {"listing": 1})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20 and len(pickle.dumps(parts)) < 100_000  # 13 MB, and 0.7 MB, with all names
    rows, tasks = given(stream, 0, 1)
    assert len(rows) == sum(rows.values()) == 20_000 and 79 <= tasks <= 256


def test_large_batches_have_larger_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(bundle, "_MOST_TASKS", 50)
    for i in range(3000):
        (tmp_path / f"n{i}.md").write_text(str(i))
    stream = reader(tmp_path, tmp_path.parent / f"{tmp_path.name}-state", filesperpartition="10")
    rows, tasks = given(stream, 0, stream.latestOffset()["listing"])
    assert rows == Counter({("main", f"n{i}.md", str(i).encode()): 1 for i in range(3000)}) and tasks <= 200


def test_a_batch_of_several_listings_has_a_file_once(tmp_path):
    roots = [tmp_path / "a", tmp_path / "b"]
    for root in roots:
        root.mkdir()
        (root / "x.md").write_text("1")
        (root / "tab\tline\né.md").write_text("odd")
    named = {"path": f"{roots[0]},{roots[1]}", "bundles": "p,q"}
    assert reader("", tmp_path / "state", **named).latestOffset() == {"listing": 1}
    (roots[1] / "x.md").write_text("22")
    (roots[1] / "y.csv").write_text("no content is read")
    assert reader("", tmp_path / "state", **named).latestOffset() == {"listing": 2}
    # what is known goes by the bundle's name, whatever its place
    stream = reader("", tmp_path / "state", path=f"{roots[1]},{roots[0]}", bundles="q,p")
    assert stream.latestOffset() == {"listing": 2}
    odd = "tab\tline\né.md"
    assert given(stream, 1, 2)[0] == Counter({("q", "x.md", b"22"): 1, ("q", "y.csv", None): 1})
    assert given(stream, 0, 2)[0] == Counter({("p", "x.md", b"1"): 1, ("q", "x.md", b"22"): 1, ("p", odd, b"odd"): 1, ("q", odd, b"odd"): 1, ("q", "y.csv", None): 1})
    (roots[0] / "x.md").unlink()
    assert ("p", "x.md", b"1") not in given(stream, 0, 2)[0]
