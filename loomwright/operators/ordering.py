"""Rows cut from their lineage, and ranks over a whole table without one task that holds it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Where it is unset a session of one machine takes a temporary folder;
    on a cluster that would be a folder executors cannot read, so there it is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomwright-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small or medium table."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's path in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table of its own in the checkpoint folder: for tables that are too large to be kept row by row."""
    folder = folder or shared_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Remove a folder that ``written`` made, on whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered_within(df: DataFrame, by: str, *order, name: str = "number") -> DataFrame:
    """The same within each value of ``by``, which need not fit one task either."""
    every = cut_lineage(numbered(df, by, *order, name="_place"))
    first = every.groupBy(F.col(by).alias("_by")).agg(F.min("_place").alias("_first"))
    return every.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, F.col("_place") - F.col("_first")).drop("_by", "_place", "_first")


def numbered(df: DataFrame, *order, name: str = "number") -> DataFrame:
    """``df`` with the place of each row in the order of all rows, from zero, as ``name``.

    Rows are dealt by ranges of the order; each range is numbered by itself and moved up by the rows of the ranges
    before it, of which there is one count each.
    """
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_range").count().select(F.col("_range").alias("_r"), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(before, F.col("_range") == F.col("_r")).withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_r", "_before")
