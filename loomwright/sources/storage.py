"""Files of a tree through Arrow's file systems: local folders, HDFS and object stores by their address."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs


class UnsafePath(ValueError):
    """A relative path that would leave its tree."""


@dataclass(frozen=True)
class Entry:
    """What a folder holds under a name. Symbolic links and other special files are left out."""

    name: str
    is_dir: bool
    size: int
    modified: int  # nanoseconds since 1970


class Store:
    """The file system of a tree and the tree's own path there."""

    def __init__(self, root: str) -> None:
        if "://" in root or root.startswith("file:"):
            self.fs, path = arrow_fs.FileSystem.from_uri(root)
        else:
            self.fs, path = arrow_fs.LocalFileSystem(), os.path.abspath(root)
        self.path = path.rstrip("/") or "/"
        self.is_local = isinstance(self.fs, arrow_fs.LocalFileSystem)

    def at(self, rel_path: str) -> str:
        return f"{self.path}/{rel_path}" if rel_path else self.path

    def is_folder(self, rel_path: str = "") -> bool:
        return self.fs.get_file_info(self.at(rel_path)).type == arrow_fs.FileType.Directory

    def entries(self, rel_path: str = "") -> Iterator[Entry]:
        """What a folder holds, one entry at a time, hidden names included; nothing if it is gone meanwhile."""
        if self.is_local:  # Arrow's listing follows links
            try:
                with os.scandir(self.at(rel_path)) as found:
                    for e in found:
                        if e.is_dir(follow_symlinks=False):
                            yield Entry(e.name, True, 0, 0)
                        elif e.is_file(follow_symlinks=False):
                            about = e.stat(follow_symlinks=False)
                            yield Entry(e.name, False, about.st_size, about.st_mtime_ns)
            except FileNotFoundError:
                return
        else:
            for e in self.fs.get_file_info(arrow_fs.FileSelector(self.at(rel_path), allow_not_found=True)):
                if e.type in (arrow_fs.FileType.Directory, arrow_fs.FileType.File):
                    yield Entry(e.base_name, e.type == arrow_fs.FileType.Directory, e.size or 0, e.mtime_ns or 0)

    def walk(self, rel_path: str = "") -> Iterator[tuple[str, Entry]]:
        """(relative path, entry) of every file below a folder, one at a time."""
        todo = [rel_path]
        while todo:
            folder = todo.pop()
            for e in self.entries(folder):
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir:
                    todo.append(path)
                else:
                    yield path, e

    def read(self, rel_path: str) -> bytes:
        with self.fs.open_input_file(self.at(rel_path)) as f:
            return f.read()

    def write(self, rel_path: str, content: bytes) -> None:
        with self.fs.open_output_stream(self.at(rel_path)) as f:
            f.write(content)

    def make_folder(self, rel_path: str = "") -> None:
        self.fs.create_dir(self.at(rel_path), recursive=True)

    def remove(self) -> None:
        """The whole tree, if it is there."""
        if self.is_folder():
            self.fs.delete_dir(self.path)


def safe(rel_path: str) -> str:
    """The path, if each of its steps stays in the tree."""
    steps = rel_path.split("/")
    if "\0" in rel_path or any(s in ("", ".", "..") for s in steps):
        raise UnsafePath(f"not a path inside the tree: {rel_path!r}")
    return rel_path
