"""One text file from the rows of a table in their order, written by many tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.ordering import numbered
from .storage import Store

_COPIED = 1 << 20


@dataclass
class _Piece(WriterCommitMessage):
    """A task's part of the text, and the places of its first and last row."""

    name: str
    first: int
    last: int


class _JoinedWriter(DataSourceWriter):
    """Each task writes its rows behind one another; at commit the pieces are copied into one file, a megabyte at a time, which takes its
    place by a rename. A write that fails leaves the file as it was."""

    def __init__(self, options: dict) -> None:
        folder, _, self.name = options["path"].rstrip("/").rpartition("/")
        self.folder, self.staging = folder, f"{options['path'].rstrip('/')}.staging-{uuid.uuid4().hex}"
        self.head, self.tail, self.between = (options.get(k, "") for k in ("head", "tail", "between"))

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, name, first, last = Store(self.staging), uuid.uuid4().hex, -1, -1
        store.make_folder()
        with store.fs.open_output_stream(store.at(name)) as out:
            for r in rows:
                if first >= 0 and r.place != last + 1:
                    raise ValueError("the rows of a task are not in order")
                first, last = first if first >= 0 else r.place, r.place
                out.write(((self.between if r.place else "") + r.text).encode())
        return _Piece(name, first, last)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        staged, folder = Store(self.staging), Store(self.folder)
        pieces = sorted((m for m in messages if m is not None and m.first >= 0), key=lambda m: m.first)
        staged.make_folder()
        with staged.fs.open_output_stream(staged.at("whole")) as out:
            out.write(self.head.encode())
            place = 0
            for m in pieces:
                if m.first != place:
                    raise ValueError("the pieces are not in order")
                place = m.last + 1
                with staged.fs.open_input_stream(staged.at(m.name)) as piece:
                    while part := piece.read(_COPIED):
                        out.write(part)
            out.write(self.tail.encode())
        folder.make_folder()
        staged.fs.move(staged.at("whole"), folder.at(self.name))
        staged.remove()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        Store(self.staging).remove()


class JoinedText(DataSource):
    """``format("joined_text")``: rows of ``place, text``, dealt out by ranges of ``place`` and in order, as one file."""

    @classmethod
    def name(cls) -> str:
        return "joined_text"

    def writer(self, schema, overwrite: bool) -> _JoinedWriter:
        return _JoinedWriter(dict(self.options))


def write_joined(rows: DataFrame, text: Column | str, *order, path: str, head: str = "", between: str = "", tail: str = "") -> None:
    """The texts of ``rows`` in ``order`` as the file ``path``: ``head``, the texts with ``between`` among them, ``tail``. Places are given by
    ranges, tasks write their own, and the driver only copies pieces, so no memory holds the text."""
    text = F.col(text) if isinstance(text, str) else text
    rows.sparkSession.dataSource.register(JoinedText)
    placed = numbered(rows.withColumn("_text", text), *order, name="_place").select(F.col("_place").cast("long").alias("place"), F.col("_text").alias("text"))
    dealt = placed.repartitionByRange("place").sortWithinPartitions("place")
    dealt.write.format("joined_text").options(head=head, between=between, tail=tail).mode("append").save(path)
