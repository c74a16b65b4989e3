"""Cross-links kept up to date while concepts arrive, and sessions of events that come late or twice."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.ordering import shared_folder
from ..sources.bundle import tree_stream, write_tree
from ..sources.parse import parsed

_EVENT = "bundle string, target string, src_id string, seq int, pos int, raw string"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Each batch adds what it changed to a log, in place of a new snapshot of all; and a join keeps its state in one store a task, not four.
_ON_DISK = (_PROVIDER, ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"), ("spark.sql.streaming.join.stateFormatVersion", "3"))


@contextmanager
def _kept_on_disk(spark: SparkSession) -> Iterator[None]:
    """State on disk while a query starts, so that what waits need not fit memory."""
    before = {name: spark.conf.get(name, None) for name, _ in _ON_DISK}
    for name, value in _ON_DISK:
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def link_events(rows: DataFrame) -> DataFrame:
    """Of parsed concepts: a row that each is there (``seq`` -1) and one for each reading ``pos`` of each of its links, by the id it is about."""
    concepts = rows.where("role = 'concept' and error is null")
    # the concept itself stands before its links, so that one pass gives both
    concepts = concepts.withColumn("links", F.concat(F.array(F.lit(None).cast("struct<text:string,raw:string,decoded:string>")), "links"))
    each = graph.raw_links(concepts)
    own = F.array(F.struct(F.col("src_id").alias("target"), F.lit(0).alias("pos")))
    read = F.transform("candidates", lambda c, i: F.struct(F.array_join(c, "/").alias("target"), i.alias("pos")))
    each = each.select("bundle", "src_id", (F.col("seq") - 1).alias("seq"), "raw", F.explode(F.when(F.col("seq") == 0, own).otherwise(read)).alias("c"))
    return each.select("bundle", F.col("c.target").alias("target"), "src_id", "seq", F.col("c.pos").alias("pos"), "raw")


def met(links: DataFrame, there: DataFrame) -> DataFrame:
    """Links whose concept is there, told once both have arrived, whichever comes first; both are ``link_events`` streams. What waits is rows
    of the join's state, by the id they are about."""
    links = links.where("seq >= 0")
    there = there.where("seq < 0").select(F.col("bundle").alias("known_bundle"), F.col("target").alias("known"))
    return links.join(there, (F.col("bundle") == F.col("known_bundle")) & (F.col("target") == F.col("known"))).select("bundle", "target", "src_id", "seq", "pos", "raw")


def resolved(told: DataFrame) -> DataFrame:
    """``bundle, src_id, seq, target_id, exists, raw`` from all that was told: of each link its first reading that exists, else its first."""
    now = told.groupBy("bundle", "src_id", "seq", "pos").agg(F.bool_or("exists").alias("exists"), F.min("target").alias("target"), F.min("raw").alias("raw"))
    best = now.groupBy("bundle", "src_id", "seq").agg(F.min_by(F.struct("target", "exists", "raw"), F.struct(~F.col("exists"), "pos")).alias("b"))
    return best.select("bundle", "src_id", F.col("seq").cast("long").alias("seq"), F.col("b.target").alias("target_id"), "b.exists", "b.raw")


def linked_steps(spark: SparkSession, steps: list[DataFrame]) -> Iterator[DataFrame]:
    """A tree that grows by each of ``steps`` (``bundle, rel_path, content`` of one bundle): its resolved links after each, by streams
    that are started anew and go on from their checkpoints: one parses what is new, one brings links and concepts together. Concepts are
    taken as they first arrive."""
    folder = shared_folder(spark, "linked")

    def run(made: DataFrame, what: str) -> None:
        def keep(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/{what}/epoch={epoch}")

        made.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint-{what}").trigger(availableNow=True).start().awaitTermination()

    for files in steps:
        bundle = files.select("bundle").first()
        write_tree(files, f"{folder}/tree")
        run(link_events(parsed(tree_stream(spark, f"{folder}/tree", f"{folder}/listings", bundle.bundle if bundle else "main"))), "events")
        events = lambda: spark.readStream.schema(_EVENT).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events/*")
        with _kept_on_disk(spark):
            run(met(events(), events()), "met")
        read = lambda what: spark.read.schema(_EVENT).parquet(f"{folder}/{what}")
        yield resolved(read("events").where("seq >= 0").withColumn("exists", F.lit(False)).unionByName(read("met").withColumn("exists", F.lit(True)), allowMissingColumns=True))


def sessions(events: DataFrame, late: str = "2 days", gap: str = "6 hours") -> DataFrame:
    """``user_id, began, n`` of the sessions of ``event_id, ts, user_id`` rows: their time is the rows' own. A row that comes again counts once,
    one later than ``late`` behind the newest of earlier batches not at all."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("began"), "n")


def session_table(spark: SparkSession, steps: list[DataFrame], late: str = "2 days", gap: str = "6 hours") -> DataFrame:
    """Sessions of rows that a producer leaves in ``steps``, each read by a run of its own."""
    folder = shared_folder(spark, "sessions")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/epoch={epoch}")

    for number, rows in enumerate(steps):
        rows.coalesce(1).write.parquet(f"{folder}/in/step={number}")
        stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/in/*")
        made = sessions(stream.select("event_id", "ts", "user_id"), late, gap)
        made.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, began timestamp, n long").parquet(f"{folder}/table")
