"""Tables of bundles that keep their layout: parsed files with digests, ids and links in buckets of what joins them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.parse import digest, parsed
from .bundle import Bundle

#: Buckets of ids and links; more for larger bundles, and the same for both.
BUCKETS = 32
_IDS = "bundle string, id string"
_LINKS = "bundle string, target_id string, src_id string, seq int, raw string"


class BundleTables:
    """What ``save`` wrote at ``path``. Buckets are part of the tables' definitions, which are made anew in each session; the files stay."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _name(self, what: str) -> str:
        return f"loomwright_{what}_{hashlib.sha256(f'{self.path}/{self.buckets}'.encode()).hexdigest()[:16]}"

    def _bucketed(self, df: DataFrame, what: str, *keys: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(what)}")
        df.write.format("parquet").mode("overwrite").bucketBy(self.buckets, *keys).sortBy(*keys).option("path", f"{self.path}/{what}").saveAsTable(self._name(what))

    def _table(self, what: str, schema: str, *keys: str) -> DataFrame:
        location = f"{self.path}/{what}".replace("'", r"\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(what)} ({schema}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {self.buckets} BUCKETS LOCATION '{location}'")
        return self.spark.table(self._name(what))

    @property
    def rows(self) -> DataFrame:
        """Parsed files, with the digest of each one's content."""
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def ids(self) -> DataFrame:
        return self._table("ids", _IDS, "bundle", "id")

    @property
    def plain_links(self) -> DataFrame:
        """Links with one reading, by their target."""
        return self._table("links", _LINKS, "bundle", "target_id")

    def links(self) -> DataFrame:
        """``bundle, src_id, seq, target_id, exists, raw``: links and ids lie in the same buckets, so their join moves no row. The few links
        with two readings are resolved apart."""
        known = self.ids.withColumnRenamed("bundle", "known_bundle")
        plain = self.plain_links
        one = plain.join(known.hint("merge"), (plain["bundle"] == known["known_bundle"]) & (plain["target_id"] == known["id"]), "left")
        one = one.select("bundle", "src_id", "seq", "target_id", F.col("id").isNotNull().alias("exists"), "raw")
        many = self.spark.read.parquet(f"{self.path}/double_links")
        if many.isEmpty():
            return one
        two = graph.first_existing(many, ["bundle", "src_id", "seq"], "candidates", self.ids)
        return one.unionByName(two.select("bundle", "src_id", "seq", F.array_join("target_segs", "/").alias("target_id"), "exists", "raw"))

    def changed(self, files: DataFrame) -> DataFrame:
        """Those of ``files`` that are new or whose content is not the one that was parsed."""
        return files.withColumn("digest", digest()).join(self.rows.select("bundle", "rel_path", "digest"), ["bundle", "rel_path", "digest"], "left_anti")

    def refreshed(self, files: DataFrame, path: str) -> BundleTables:
        """Tables of ``files`` at another ``path``, for which only changed files are parsed."""
        now = files.where(F.element_at(F.split("rel_path", "/"), -1).rlike(r"(?s).\.md\z")).select("bundle", "rel_path", digest())
        kept = self.rows.join(now, ["bundle", "rel_path", "digest"], "left_semi")
        new = parsed(self.changed(files), keep="digest string")
        return _written(self.spark, kept.unionByName(new), path, self.buckets)


def save(bundle: Bundle, path: str, buckets: int = BUCKETS) -> BundleTables:
    """The tables of a bundle, to be read by ``BundleTables`` in any session."""
    return _written(bundle.files.sparkSession, bundle.rows, path, buckets)


def _written(spark: SparkSession, rows: DataFrame, path: str, buckets: int) -> BundleTables:
    made = BundleTables(spark, path, buckets)
    rows.write.mode("overwrite").parquet(f"{made.path}/rows")
    concepts = made.rows.where("role = 'concept' and error is null")
    made._bucketed(graph.ids(concepts), "ids", "bundle", "id")
    raw = graph.raw_links(concepts)
    one = raw.where(F.size("candidates") == 1).select("bundle", F.array_join(F.col("candidates")[0], "/").alias("target_id"), "src_id", "seq", "raw")
    made._bucketed(one, "links", "bundle", "target_id")
    raw.where(F.size("candidates") > 1).write.mode("overwrite").parquet(f"{made.path}/double_links")
    return made
