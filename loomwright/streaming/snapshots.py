"""Structured Streaming over bundles: new and changed files as they arrive, late dates in logs, snapshot changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import trimmed
from ..operators import logs
from ..operators.ordering import shared_folder
from ..plans.bundle import Bundle
from ..sources.bundle import FILES, tree_stream, write_tree
from ..sources.parse import parsed

STREAM = FILES + ", arrived timestamp"


def file_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of ``bundle, rel_path, content, arrived`` rows that a producer appends as Parquet."""
    return spark.readStream.schema(STREAM).option("maxFilesPerTrigger", str(max_files)).parquet(path)


def concept_types(stream: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """How many markdown files of each type arrived in each window, ``(none)`` without one; rows later than ``late`` no
    longer count."""
    rows = parsed(stream.withWatermark("arrived", late), keep="arrived timestamp")
    kind = trimmed(F.try_element_at("node", F.lit("type"))["text"])
    return rows.groupBy(F.window("arrived", window), F.coalesce(F.nullif(kind, F.lit("")), F.lit("(none)")).alias("type")).agg(F.count("*").alias("n"))


def log_counts(stream: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Log bullets in each arrival window, by bundle; the watermark drops rows later than ``late``."""
    own = stream.withWatermark("arrived", late).where(F.col("rel_path").rlike(r"(^|/)log\.md$"))
    bullets = F.size(F.filter(F.split(F.decode("content", "utf-8"), "\n"), lambda x: F.trim(x).rlike("^[*-] ")))
    return own.groupBy(F.window("arrived", window), "bundle").agg(F.sum(bullets.cast("long")).alias("n_bullets"), F.count("*").alias("n_files"))


def log_entries(stream: DataFrame, table: str, checkpoint: str, **trigger):
    """Keeps ``table`` of all log entries of the files that arrive. Each micro-batch has a folder of its own there, so that
    a batch that is run again replaces what it wrote before."""

    def step(batch: DataFrame, number: int) -> None:
        rows = parsed(batch.where(F.col("rel_path").rlike(r"(^|/)log\.md$")))
        logs.entries(logs.lines(rows)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def snapshot_changes(spark: SparkSession, stream: DataFrame, state: str, on_changes: Callable[[DataFrame, int], None], checkpoint: str):
    """Compare each micro-batch, a snapshot of a bundle, with the one before, kept as a table at ``state``.

    A batch that is run again compares with the same table: batches write to three places in turn, so that the one
    before stays and older ones are overwritten.
    """

    def step(batch: DataFrame, number: int) -> None:
        place = lambda n: f"{state}/{n % 3}"
        batch.select("bundle", "rel_path", "content").write.mode("overwrite").parquet(place(number))
        now = Bundle(spark.read.parquet(place(number)))
        if number:
            before = Bundle(spark.read.parquet(place(number - 1)))
            on_changes(before.diff(now), number)
            before.release()
        now.release()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def _arriving(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """``files`` as a stream that reads what a producer has left in ``folder``."""
    files.withColumn("arrived", F.timestamp_seconds(F.lit(0))).write.parquet(f"{folder}/in")
    return file_stream(spark, f"{folder}/in", 4)


def log_table(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Log entries of ``files`` through a stream that runs until all is read."""
    folder = shared_folder(spark, "stream")
    log_entries(_arriving(spark, files, folder), f"{folder}/table", f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{folder}/table")


def type_table(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``window, type, n`` of ``files`` through a stream with state that runs until all is read. Each trigger writes the groups it
    updated, and the last update of a group counts."""
    folder = shared_folder(spark, "stream")

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("update", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    counts = concept_types(_arriving(spark, files, folder))
    counts.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/table").groupBy("window", "type").agg(F.max_by("n", "update").alias("n"))


def arrivals(spark: SparkSession, steps: list[DataFrame]) -> DataFrame:
    """``rel_path, content, step``: a tree that grows by each of ``steps`` (``bundle, rel_path, content``), read by a stream that is
    started anew after each and goes on from its checkpoint; ``step`` says in which run a file arrived."""
    folder = shared_folder(spark, "growing")
    for number, files in enumerate(steps):
        write_tree(files, f"{folder}/tree")
        stream = tree_stream(spark, f"{folder}/tree", f"{folder}/listings")

        def keep(batch: DataFrame, epoch: int, number: int = number) -> None:
            batch.select("rel_path", "content").write.mode("overwrite").parquet(f"{folder}/table/step={number}/epoch={epoch}")

        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("rel_path", "content", F.col("step").cast("long").alias("step"))
