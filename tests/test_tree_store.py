"""Trees as a data source: listing in tasks, writing with a commit, and streams of what arrives."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomwright.sources import bundle
from loomwright.sources.storage import Store, UnsafePath, safe


def tree(root):
    return {p: Store(str(root)).read(p) for p in bundle.listed(str(root))}


@pytest.fixture
def home(tmp_path):
    root = tmp_path / "b"
    for p, c in {"a.md": "A", ".hidden/x.md": "X", "_u/y.md": "Y", "d/e/f.md": "F", "d/data.csv": "1,2", "with space é/g.md": "G"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(c)
    (root / "d" / "link.md").symlink_to(root / "a.md")
    (root / "loop").symlink_to(root)
    return root


def rows(df):
    return {(r.bundle, r.rel_path, None if r.content is None else bytes(r.content)) for r in df.collect()}


def test_every_way_of_reading_finds_the_same_files(spark, home):
    want = {("main", p, None if p.endswith(".csv") else c.encode()) for p, c in {"a.md": "A", ".hidden/x.md": "X", "_u/y.md": "Y", "d/e/f.md": "F", "d/data.csv": "1,2", "with space é/g.md": "G"}.items()}
    assert rows(bundle.read_tree(spark, str(home))) == want
    assert rows(bundle.read_tree(spark, home.as_uri())) == want
    spark.dataSource.register(bundle.BundleSource)
    for folders in ("1", "2", "1000"):
        assert rows(spark.read.format("bundle").option("folders", folders).load(str(home))) == want
    assert {r.rel_path: r["size"] for r in bundle.listed_tree(spark, str(home)).collect()}["d/data.csv"] == 3
    with pytest.raises(bundle.NotABundle):
        bundle.read_tree(spark, str(home / "a.md"))
    (home / "empty").mkdir()
    assert bundle.read_tree(spark, str(home / "empty")).count() == 0


def test_a_wide_folder_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    for i in range(3000):
        (tmp_path / f"n{i}.md").write_text(str(i))
    monkeypatch.setattr(bundle, "TASK_FILES", 300)
    df = bundle.read_tree(spark, str(tmp_path))
    each = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(each) == 3000 and len(each) == 10 and max(each) < 450


def test_written_trees_are_read_back(spark, tmp_path):
    root = str(tmp_path / "out" / "tree")
    files = bundle.from_rows(spark, [(f"d{i % 7}/x{i}.md", f"text {i}") for i in range(60)] + [("é ü/.h.md", "hidden"), ("data.csv", b"\xff\x00")]).repartition(5)
    bundle.write_tree(files, root)
    assert tree(root) == {r.rel_path: bytes(r.content) for r in files.collect()}
    bundle.write_tree(bundle.from_rows(spark, [("d1/x1.md", "new"), ("z.md", "z"), ]).unionByName(spark.createDataFrame([("main", "gone.md", None)], bundle.FILES)), root)
    assert tree(root)["d1/x1.md"] == b"new" and tree(root)["z.md"] == b"z" and len(tree(root)) == 63
    bundle.write_tree(bundle.from_rows(spark, [("only.md", "o")]), root, "overwrite")
    assert tree(root) == {"only.md": b"o"}
    assert os.listdir(tmp_path / "out") == ["tree"]


def test_bundles_in_folders_of_their_own(spark, tmp_path):
    files = bundle.from_rows(spark, [("a.md", "1")], "x").unionByName(bundle.from_rows(spark, [("a.md", "2")], "y"))
    bundle.write_tree(files, f"file://{tmp_path}/t", by_bundle=True)
    assert tree(tmp_path / "t") == {"x/a.md": b"1", "y/a.md": b"2"}
    with pytest.raises(ValueError, match="several rows"):
        bundle.write_tree(files, f"file://{tmp_path}/u")
    assert not (tmp_path / "u").exists()


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_a_write_that_fails_leaves_the_tree_as_it_was(spark, tmp_path, mode):
    root = str(tmp_path / "t")
    bundle.write_tree(bundle.from_rows(spark, [("a.md", "old"), ("b.md", "old")]), root)
    bad = bundle.from_rows(spark, [("a.md", "new"), *((f"c{i}.md", "new") for i in range(20)), ("../out.md", "x")]).repartition(4)
    with pytest.raises(PySparkException):
        bundle.write_tree(bad, root, mode)
    assert tree(root) == {"a.md": b"old", "b.md": b"old"} and os.listdir(tmp_path) == ["t"]


def test_paths_stay_inside():
    assert safe("a/b.md") == "a/b.md" and safe("..a/b..md") == "..a/b..md"
    for bad in ("/a", "a//b", "../a", "a/../../b", "", "a/.", "a\0"):
        with pytest.raises(UnsafePath):
            safe(bad)


def test_a_stream_gives_each_file_once_and_goes_on_after_a_crash(spark, tmp_path):
    root, seen = str(tmp_path / "t"), []

    def run(fail=False):
        def step(batch, number):
            if fail:
                raise RuntimeError("crash")
            seen.append((number, rows(batch)))

        query = bundle.tree_stream(spark, root, str(tmp_path / "state")).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        if fail:
            with pytest.raises(Exception, match="crash"):
                query.awaitTermination()
        else:
            query.awaitTermination()

    bundle.write_tree(bundle.from_rows(spark, [("a.md", "1"), ("d/.b.md", "2")]), root)
    run()
    assert seen == [(0, {("main", "a.md", b"1"), ("main", "d/.b.md", b"2")})]
    run()
    assert len(seen) == 1  # nothing new
    bundle.write_tree(bundle.from_rows(spark, [("a.md", "changed"), ("e.md", "3")]), root)
    run(fail=True)
    bundle.write_tree(bundle.from_rows(spark, [("f.md", "4")]), root)
    run()
    # the batch that failed comes again as it was planned, and what came later with the next
    assert seen[1:] == [(1, {("main", "a.md", b"changed"), ("main", "e.md", b"3")})]
    run()
    assert seen[1:] == [(1, {("main", "a.md", b"changed"), ("main", "e.md", b"3")}), (2, {("main", "f.md", b"4")})]
