"""Reading and writing bundles: directory trees in any store, rows in memory, and trees that grow as streams."""

from __future__ import annotations

import json
import tempfile
import uuid
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.ordering import shared_folder, written
from .storage import Store, safe

FILES = "bundle string, rel_path string, content binary"
_LISTED = "folder string, name string, is_dir boolean, size long, modified long"
#: Files and bytes of a task that reads contents; rows and bytes of a batch; files moved at a time when a write is committed.
TASK_FILES, TASK_BYTES = 10_000, 64 << 20
_BATCH_ROWS, _BATCH_BYTES = 4096, 8 << 20
_MOVERS = 16
#: Parts of a stream's listing that are compared one after the other; tasks of a batch at most, so that larger batches have larger tasks.
_BUCKETS, _MOST_TASKS = 128, 1024


class NotABundle(ValueError):
    """The root is no directory."""


def _named(options: dict) -> list[tuple[str, str]]:
    """(bundle name, root) of comma-separated roots."""
    roots = [p for p in options["path"].split(",") if p]
    names = options["bundles"].split(",") if options.get("bundles") else ["main", *(f"b{i}" for i in range(1, len(roots)))]
    return list(zip(names, roots, strict=True))


def _content(store: Store, rel_path: str) -> bytes | None:
    """Of markdown files; other files are listed only, since path fields may name them."""
    return store.read(rel_path) if rel_path.endswith(".md") else None


@dataclass
class _Part(InputPartition):
    """Files and whole folders of a tree."""

    bundle: str
    root: str
    files: list[str]
    folders: list[str]


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.trees = _named(options)
        self.all_files = options.get("allfiles", "true") == "true"
        self.per_part = int(options.get("filesperpartition", "256"))
        self.folders = int(options.get("folders", "1024"))

    def partitions(self) -> list[InputPartition]:
        """The upper folders are listed here until there are enough of them to deal out; the tasks list what is below."""
        parts = []
        for bundle, root in self.trees:
            store, todo, files = Store(root), deque([""]), []
            while todo and len(todo) < self.folders:
                folder = todo.popleft()
                for e in store.entries(folder):
                    path = f"{folder}/{e.name}" if folder else e.name
                    (todo if e.is_dir else files).append(path)
            parts += [_Part(bundle, root, files[i : i + self.per_part], []) for i in range(0, len(files), self.per_part)]
            parts += [_Part(bundle, root, [], [folder]) for folder in todo]
        return parts or [_Part("", "", [], [])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        store = Store(partition.root) if partition.root else None
        for rel in partition.files:
            if self.all_files or rel.endswith(".md"):
                yield partition.bundle, rel, _content(store, rel)
        for folder in partition.folders:
            for rel, _ in store.walk(folder):
                if self.all_files or rel.endswith(".md"):
                    yield partition.bundle, rel, _content(store, rel)


@dataclass
class _Staged(WriterCommitMessage):
    """Where a task has left its files, and how many."""

    folder: str
    files: int


class _TreeWriter(DataSourceWriter):
    """Tasks write below a folder beside the tree, each attempt below a name of its own; at commit the files of the attempts that
    count move to their places, by renames on the same store. Until then the tree is as it was."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.overwrite = options["path"].rstrip("/"), overwrite
        self.by_bundle = options.get("bundlefolders", "false") == "true"
        self.staging = f"{self.root}.staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        folder, store, made, n = uuid.uuid4().hex, Store(self.staging), set(), 0
        for r in rows:
            if r.content is None:
                continue
            path = f"{folder}/{safe(f'{r.bundle}/{r.rel_path}' if self.by_bundle else r.rel_path)}"
            above = path.rpartition("/")[0]
            if above not in made:
                store.make_folder(above)
                made.add(above)
            store.write(path, bytes(r.content))
            n += 1
        return _Staged(folder, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        staged, root = Store(self.staging), Store(self.root)
        into = Store(f"{self.staging}/whole") if self.overwrite else root
        into.make_folder()
        made = None  # files of a folder come one after the other

        def place(from_path: str, rel: str) -> None:
            staged.fs.move(staged.at(from_path), into.at(rel))

        with ThreadPoolExecutor(_MOVERS) as movers:
            waiting: deque = deque()
            for message in messages:
                if message is None or not message.files:
                    continue
                for path, _ in staged.walk(message.folder):
                    rel = path.partition("/")[2]
                    above = rel.rpartition("/")[0]
                    if above != made:
                        into.make_folder(above)
                        made = above
                    waiting.append(movers.submit(place, path, rel))
                    if len(waiting) > 64 * _MOVERS:
                        waiting.popleft().result()
            for moved in waiting:
                moved.result()
        if self.overwrite:  # the old tree goes only once the new one stands whole in its place
            old = f"{staged.path}/old"
            if root.is_folder():
                root.fs.move(root.path, old)
            root.fs.move(into.path, root.path)
        staged.remove()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        Store(self.staging).remove()


@dataclass
class _Slice(InputPartition):
    """Every ``of``-th file, from number ``first`` on, of what listings have in a range of buckets."""

    ranges: list[tuple[str, int, int]]  # file of lines, begin, length
    trees: list[list[tuple[str, str]]]
    first: int
    of: int


class _TreeStream(DataSourceStreamReader):
    """New and changed files of a tree. An offset is the number of a listing kept in the ``state`` folder, each with what it has
    beyond those before; a batch that is planned again reads the same listings, so it has the same files.

    A listing is a file of lines (number of the tree, path as JSON, size and time) by buckets of the path, and, once that is whole, a
    small one that says where each bucket is. The driver's Python holds one bucket at a time, and what was listed before waits in
    temporary files; tasks get ranges of the listing and read the names there."""

    def __init__(self, options: dict) -> None:
        if not options.get("state"):
            raise ValueError("a stream of a tree needs the option `state`: a folder for its listings")
        self.trees, self.state = _named(options), Store(options["state"])
        self.all_files = options.get("allfiles", "true") == "true"
        self.per_part = int(options.get("filesperpartition", "256"))
        self.known: list | None = None
        self.last = 0

    def _about(self, number: int) -> dict:
        return json.loads(self.state.read(f"{number:012d}.json"))

    def _load(self) -> None:
        self.state.make_folder()
        self.known = [tempfile.TemporaryFile() for _ in range(_BUCKETS)]
        own = {bundle: tree for tree, (bundle, _) in enumerate(self.trees)}
        for number in sorted(int(e.name[:-5]) for e in self.state.entries() if e.name.endswith(".json")):
            about = self._about(number)
            for known, (begin, length, _) in zip(self.known, about["buckets"], strict=True):
                for line in _lines(self.state, about["lines"], begin, length):
                    tree, rest = line.split(b"\t", 1)
                    bundle = about["trees"][int(tree)][0]
                    if bundle in own:
                        known.write(b"%d\t%s\n" % (own[bundle], rest))
            self.last = number

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.known is None:
            self._load()
        found = [tempfile.TemporaryFile() for _ in range(_BUCKETS)]
        for tree, (_, root) in enumerate(self.trees):
            for rel, e in Store(root).walk():
                if self.all_files or rel.endswith(".md"):
                    path = json.dumps(rel).encode()
                    found[zlib.crc32(path) % _BUCKETS].write(b"%d\t%s\t%d %d\n" % (tree, path, e.size, e.modified))
        buckets, at, listing, name = [], 0, None, f"{uuid.uuid4().hex}.lines"
        try:
            for known, now in zip(self.known, found, strict=True):
                known.seek(0)
                now.seek(0)
                before = dict(line.rsplit(b"\t", 1) for line in known)
                new = [line for line in now for path, about in [line.rsplit(b"\t", 1)] if before.get(path) != about]
                now.close()
                lines = b"".join(new)
                buckets.append((at, len(lines), len(new)))
                at += len(lines)
                if new:
                    listing = listing or self.state.fs.open_output_stream(self.state.at(name))
                    listing.write(lines)
                    known.write(lines)
            if listing:
                listing.close()
                # a listing is there whole or not at all
                self.state.write("next", json.dumps({"lines": name, "trees": self.trees, "buckets": buckets}).encode())
                self.state.fs.move(self.state.at("next"), self.state.at(f"{self.last + 1:012d}.json"))
                self.last += 1
        except BaseException:
            self.known = None  # it may hold what no listing tells
            raise
        return {"listing": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        abouts = [self._about(number) for number in range(start["listing"] + 1, end["listing"] + 1)]
        trees = [about["trees"] for about in abouts]
        counts = [sum(about["buckets"][i][2] for about in abouts) for i in range(_BUCKETS)]
        most = max(self.per_part, -(-sum(counts) // _MOST_TASKS))

        def part(first: int, last: int) -> list[_Slice]:
            """Of the buckets from ``first`` to ``last``, which lie together in each listing."""
            ranges = [(about["lines"], about["buckets"][first][0], sum(about["buckets"][last][:2]) - about["buckets"][first][0]) for about in abouts]
            tasks = max(1, -(-sum(counts[first : last + 1]) // most))
            return [_Slice(ranges, trees, i, tasks) for i in range(tasks)]

        parts, first = [], 0
        for i in range(_BUCKETS):
            if i + 1 == _BUCKETS or sum(counts[first : i + 2]) > most:
                parts += part(first, i)
                first = i + 1
        return parts

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        stores: dict[str, Store] = {}
        names: list[str] = []
        paths: list[str] = []
        contents: list[bytes | None] = []
        held = 0
        for bundle, root, rel in self._files(partition):
            store = stores.get(root) or stores.setdefault(root, Store(root))
            try:
                contents.append(_content(store, rel))
            except FileNotFoundError:  # gone since it was listed
                continue
            names.append(bundle)
            paths.append(rel)
            held += len(contents[-1] or b"")
            if held > _BATCH_BYTES or len(paths) == _BATCH_ROWS:
                yield _contents(names, paths, contents)
                names, paths, contents, held = [], [], [], 0
        yield _contents(names, paths, contents)

    def _files(self, part: _Slice) -> Iterator[tuple[str, str, str]]:
        lines = ((trees, line.split(b"\t")) for (name, *at), trees in zip(part.ranges, part.trees, strict=True) for line in _lines(self.state, name, *at))
        each = ((*trees[int(tree)], json.loads(path)) for trees, (tree, path, _) in lines)
        # a file that changed between two listings of a batch is in both
        for i, file in enumerate(each if len(part.ranges) == 1 else dict.fromkeys(each)):
            if i % part.of == part.first:
                yield file


def _lines(state: Store, name: str, begin: int, length: int) -> Iterator[bytes]:
    """Lines of a part of a listing."""
    if length:
        with state.fs.open_input_file(state.at(name)) as lines:
            lines.seek(begin)
            yield from lines.read(length).splitlines()


class BundleSource(DataSource):
    """``spark.read.format("bundle").load(root)``: every regular file under the root, hidden names included.

    Spark's own file source leaves out names that start with a dot or an underscore, which a bundle may have.
    Symbolic links are not followed. Only markdown files carry their content; the rest are listed, since
    path fields may name them. Options: ``bundles`` (names of comma-separated roots), ``allFiles``,
    ``filesPerPartition``, ``folders`` (how many folders are listed before the tasks list those below).

    ``df.write.format("bundle").mode(...).save(root)`` writes ``rel_path, content`` (and with ``bundleFolders`` a folder for
    each ``bundle``): ``append`` adds files to a tree and replaces those of the same name, ``overwrite`` puts a whole new
    tree in its place. A write that fails leaves the tree as it was. Rows without content are passed over.

    ``spark.readStream.format("bundle").option("state", folder).load(root)`` gives files as they come and change.
    """

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> _TreeReader:
        return _TreeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _TreeWriter:
        return _TreeWriter(dict(self.options), overwrite)

    def streamReader(self, schema) -> _TreeStream:  # noqa: N802
        return _TreeStream(dict(self.options))


def listed(root: str) -> list[str]:
    """Relative paths of the files of a small tree, in order."""
    return sorted((p for p, _ in Store(root).walk()), key=lambda p: p.split("/"))


def listed_tree(spark: SparkSession, root: str) -> DataFrame:
    """``rel_path, size, modified`` of every file of a tree, listed a level at a time: each folder by a task, which passes on what
    it finds as it finds it. The driver sees how many folders a level has, and nothing else."""
    if not Store(root).is_folder():
        raise NotABundle(f"bundle root is not a directory: {root}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for b in batches:
            for folder in b.column("folder").to_pylist():
                rows: list[tuple] = []
                for e in store.entries(folder):
                    rows.append((folder, e.name, e.is_dir, e.size, e.modified))
                    if len(rows) == _BATCH_ROWS:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    level = spark.createDataFrame([("",)], "folder string")
    files = None
    while True:
        found = written(level.mapInArrow(run, _LISTED))
        path = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
        own = found.where("not is_dir").select(path.alias("rel_path"), "size", "modified")
        files = own if files is None else files.unionByName(own)
        folders = found.where("is_dir").select(path.alias("folder"))
        if folders.isEmpty():
            return files
        level = folders.repartition("folder")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _LISTED.split(", ")])


def read_tree(spark: SparkSession, root: str, bundle: str = "main") -> DataFrame:
    """``bundle, rel_path, content`` of a directory tree in a store that driver and executors reach, hidden names included.

    The tree is listed when this is called; contents are read by the tasks that use them, dealt out by number and size, so a
    folder of very many files is read by many tasks."""
    files = listed_tree(spark, root)
    about = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, about.n // TASK_FILES, about.bytes // TASK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for b in batches:
            paths: list[str] = []
            contents: list[bytes | None] = []
            held = 0
            for rel in b.column("rel_path").to_pylist():
                try:
                    contents.append(_content(store, rel))
                except FileNotFoundError:  # gone since it was listed
                    continue
                paths.append(rel)
                held += len(contents[-1] or b"")
                if held > _BATCH_BYTES:
                    yield _contents([bundle] * len(paths), paths, contents)
                    paths, contents, held = [], [], 0
            yield _contents([bundle] * len(paths), paths, contents)

    return files.select("rel_path").repartition(tasks, "rel_path").mapInArrow(run, FILES)


def _contents(bundles: list[str], paths: list[str], contents: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bundles, pa.string()), pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["bundle", "rel_path", "content"])


def write_tree(files: DataFrame, root: str, mode: str = "append", by_bundle: bool = False) -> None:
    """``files`` (``bundle, rel_path, content``) as a directory tree; with ``by_bundle`` each bundle in a folder of its name. Two
    rows for one path are an error, before anything is written."""
    place = ["bundle", "rel_path"] if by_bundle else ["rel_path"]
    twice = files.where("content is not null").groupBy(*place).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several rows have the path {'/'.join(twice[0][c] for c in place)}")
    files.sparkSession.dataSource.register(BundleSource)
    rows = files.select(F.col("bundle").cast("string").alias("bundle"), F.col("rel_path").cast("string").alias("rel_path"), F.col("content").cast("binary").alias("content"))
    rows.write.format("bundle").option("bundleFolders", str(by_bundle).lower()).mode(mode).save(root)


def tree_stream(spark: SparkSession, root: str, state: str, bundle: str = "main") -> DataFrame:
    """New and changed files of a tree as a stream; ``state`` is a folder of the stream's own for its listings, beside its checkpoint."""
    spark.dataSource.register(BundleSource)
    return spark.readStream.format("bundle").option("bundles", bundle).option("state", state).load(root)


def read_lake(spark: SparkSession, path: str, bundle: str = "main") -> DataFrame:
    """The same as ``read_tree`` from a store that Spark reads and Arrow does not, by Spark's binary file source: names with a
    leading dot or underscore are not seen there, and symbolic links are followed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = F.lit(path.rstrip("/") + "/")
    return found.select(F.lit(bundle).alias("bundle"), F.element_at(F.split(F.url_decode("path"), base), -1).alias("rel_path"), "content")


def written_tree(files: DataFrame) -> DataFrame:
    """``files`` written out as a directory tree in the shared checkpoint folder, and read back from there."""
    root = shared_folder(files.sparkSession, "tree")
    write_tree(files, root)
    return read_tree(files.sparkSession, root)


def from_rows(spark: SparkSession, rows: Iterable[tuple[str, str | bytes]], bundle: str = "main") -> DataFrame:
    """``bundle, rel_path, content`` from (path, content) pairs."""
    made = [(bundle, p, c.encode() if isinstance(c, str) else c) for p, c in rows]
    return spark.createDataFrame(made, FILES)
