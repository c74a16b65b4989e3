"""A bundle as lazily planned tables, and the reports that read them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import field_paths
from ..operators import concepts as typed_columns
from ..operators import diff, graph, indexes, lint, logs, strict, validate
from ..operators.ordering import removed, shared_folder, written
from ..sources.parse import digest, parsed, with_serialized


class UnreadableConcept(ValueError):
    """A concept's file is not UTF-8."""


class Bundle:
    """All tables of one or many bundles, from rows of ``bundle, rel_path, content``.

    The parsed rows and the links before they are resolved are written to the checkpoint folder, so that a report reads
    the columns it needs, and the resolved links are persisted. Everything else is planned from them on demand.
    ``release`` lets go of them.
    """

    def __init__(self, files: DataFrame, strict: bool = False) -> None:
        self.files = files
        self.strict = strict
        self._folders: list[str] = []
        self._differs: tuple[Bundle, DataFrame, DataFrame] | None = None

    def _written(self, df: DataFrame) -> DataFrame:
        self._folders.append(shared_folder(df.sparkSession, "bundle"))
        return written(df, self._folders[-1])

    @cached_property
    def rows(self) -> DataFrame:
        """Every markdown file, parsed, with the digest of its content."""
        rows = with_serialized(self._written(parsed(self.files.withColumn("digest", digest()), keep="digest string").drop("serialized")))
        if self.strict:
            bad = rows.where("role = 'concept' and not utf8_ok").orderBy("bundle", "path_segs").limit(1).collect()
            if bad:
                raise UnreadableConcept(f"{bad[0].rel_path}: {bad[0].error}")
        return rows

    @cached_property
    def concepts(self) -> DataFrame:
        return typed_columns.typed(self.rows.where("role = 'concept' and error is null"))

    def release(self, keep: bool = False) -> None:
        """Let go of links and of written tables, or with ``keep`` of links alone, where frames that read the tables may be left."""
        if "links" in self.__dict__:
            self.links.unpersist()
        if not keep:
            for name in ("rows", "concepts", "valid_concepts", "indexes", "logs", "parse_errors", "links", "sources", "contracts", "attributions", "version"):
                self.__dict__.pop(name, None)
            self._differs = None
            while self._folders:
                removed(self.files.sparkSession, self._folders.pop())

    @cached_property
    def valid_concepts(self) -> DataFrame:
        """Concepts, or an error: a file that cannot be read or lacks a required key ends the query that reads them."""
        return strict.valid_or_fail(typed_columns.typed(strict.parsed_or_fail(self.rows).where("role = 'concept'")))

    @cached_property
    def indexes(self) -> DataFrame:
        return self.rows.where("role = 'index'")

    @cached_property
    def logs(self) -> DataFrame:
        return self.rows.where("role = 'log'")

    @cached_property
    def parse_errors(self) -> DataFrame:
        return self.rows.where("role = 'concept' and error is not null").select("bundle", "rel_path", "path_segs", "error_kind", "yaml_line", "error")

    @cached_property
    def links(self) -> DataFrame:
        return graph.links(self._written(graph.raw_links(self.concepts)), self.concepts).persist()

    @cached_property
    def sources(self) -> DataFrame:
        return graph.resolved_sources(self.concepts)

    @cached_property
    def contracts(self) -> DataFrame:
        return typed_columns.contracts(self.concepts)

    @cached_property
    def attributions(self) -> DataFrame:
        return graph.attributions(self.concepts)

    @cached_property
    def version(self) -> DataFrame:
        return validate.declared_version(self.rows)

    def backlinks(self) -> DataFrame:
        return graph.backlinks(self.links)

    def broken_links(self) -> DataFrame:
        return self.links.where("not exists").select("bundle", "src_id", "raw", "src_path", "seq")

    def links_from(self, concept: str) -> DataFrame:
        return self.links.where(F.col("src_id") == concept).orderBy("seq")

    def get(self, concept: str) -> DataFrame:
        return self.concepts.where(F.col("id") == concept)

    def contains(self, concept: str) -> bool:
        return not self.get(concept).isEmpty()

    def backlinks_of(self, concept: str) -> DataFrame:
        return self.backlinks().where(F.col("target_id") == concept).orderBy("src_path")

    def sources_of(self, concept: str) -> DataFrame:
        return self.sources.where(F.col("src_id") == concept).orderBy("seq")

    def citations(self) -> DataFrame:
        """A row for each line of a legacy citation list."""
        return self.concepts.select("bundle", "id", F.posexplode("citations").alias("pos", "c")).select("bundle", "id", "pos", "c.*")

    def footnotes(self) -> DataFrame:
        """A row for each footnote reference and definition, with its line."""
        refs = self.concepts.select("bundle", "id", F.explode("refs").alias("f")).select("bundle", "id", F.lit(False).alias("is_def"), "f.label", F.lit(None).cast("string").alias("text"), "f.line")
        defs = self.concepts.select("bundle", "id", F.explode("defs").alias("f")).select("bundle", "id", F.lit(True).alias("is_def"), "f.label", "f.text", "f.line")
        return refs.unionByName(defs)

    def resolve_paths(self, raw: DataFrame) -> DataFrame:
        """``bundle, id, raw, rel_path``: the first file that a path field of a concept can mean, null if none. ``raw``
        has ``bundle, id, raw``."""
        ways = raw.join(self.concepts.select("bundle", "id", "id_segs"), ["bundle", "id"]).select("bundle", "id", "raw", F.posexplode(field_paths(F.col("raw"), F.col("id_segs"))).alias("pos", "way"))
        hits = ways.join(self.files.select("bundle", F.col("rel_path").alias("way")).distinct(), ["bundle", "way"])
        return raw.join(hits.groupBy("bundle", "id", "raw").agg(F.min_by("way", "pos").alias("rel_path")), ["bundle", "id", "raw"], "left")

    def derived_from(self, concept: str) -> DataFrame:
        return graph.derivations(self.sources).where(F.col("src_id") == concept).orderBy("seq")

    def derives(self, concept: str) -> DataFrame:
        return graph.derived_by(self.sources).where(F.col("concept_id") == concept).orderBy("src_path")

    def of_type(self, name: str) -> DataFrame:
        return self.concepts.where(F.col("type") == name)

    def stale_on(self, day: str) -> DataFrame:
        return self.concepts.where(F.lit(day).cast("date") >= F.col("stale_after.effective"))

    def tags(self) -> DataFrame:
        return graph.tags(self.concepts)

    def log_entries(self) -> DataFrame:
        return logs.entries(logs.lines(self.logs))

    def validate(self, today: str | None = None) -> DataFrame:
        return validate.report(self.rows, self.concepts, self.files, self.links, today)

    def totals(self, today: str | None = None) -> DataFrame:
        """Findings by severity and whether a bundle conforms, a row for each bundle."""
        return validate.totals(self.validate(today), self.rows.select("bundle"))

    def lint(self, today: str | None = None, codes: tuple[str, ...] = ()) -> DataFrame:
        """Health findings, or those of ``codes``."""
        return lint.report(self.rows, self.concepts, lambda: self.links, today, codes)

    def index_texts(self, synthesize=None) -> DataFrame:
        return indexes.texts(indexes.entries(self.rows, self.files, synthesize), self.rows)

    def diff(self, other: Bundle, sections: tuple[str, ...] = diff.SECTIONS) -> DataFrame:
        """Changes from this bundle to ``other``; each holds one snapshot. Where no section is about links, and not both are parsed
        already, only files that differ are parsed."""
        if any(s.endswith("links") for s in sections):
            return diff.changes(self.concepts, other.concepts, self.links, other.links, sections)
        if self.strict or other.strict or ("rows" in self.__dict__ and "rows" in other.__dict__):
            return diff.changes(self.concepts, other.concepts, None, None, sections)
        return diff.changes(*(typed_columns.typed(rows.where("role = 'concept' and error is null")) for rows in self._differing(other)), None, None, sections)

    def _differing(self, other: Bundle) -> tuple[DataFrame, DataFrame]:
        """Parsed files of this bundle and of ``other``, those left out that both have alike; kept for the next report on the two."""
        if self._differs is None or self._differs[0] is not other:
            keys = self._written(diff.differing(self.files, other.files))
            parse = lambda b: with_serialized(self._written(parsed(b.files.join(keys, ["bundle", "rel_path"], "left_semi")).drop("serialized")))
            self._differs = (other, parse(self), parse(other))
        return self._differs[1:]

    def summary(self, today: str | None = None) -> DataFrame:
        """``bundle, measure, value``: the counts of a bundle, a row for each measure."""
        count = lambda df, name: df.groupBy("bundle").agg(F.count("*").alias("value")).select("bundle", F.lit(name).alias("measure"), "value")
        one = self.concepts.groupBy("bundle").agg(
            F.count("*").alias("concepts"),
            F.count_if(F.size("sources") > 0).alias("with_sources"),
            F.count_if("is_contract").alias("computations"),
            F.count_if(F.coalesce(F.lit(today).cast("date") >= F.col("stale_after.effective"), F.lit(False))).alias("stale"),
        ).unpivot("bundle", ["concepts", "with_sources", "computations", "stale"], "measure", "value")
        parts = [count(self.indexes, "index_files"), count(self.logs, "log_files"), count(self.links, "links"), count(self.broken_links(), "broken_links"), count(graph.derivations(self.sources), "derivation_edges"), count(graph.tag_edges(self.concepts).select("bundle", "tag").distinct(), "tags")]
        for p in parts:
            one = one.unionByName(p)
        return one

    def groups(self) -> DataFrame:
        """``bundle, what, name, n``: concepts by type, trust tier and status, in one pass."""
        named = F.explode(F.array(F.struct(F.lit("type").alias("what"), F.coalesce("type", F.lit("(none)")).alias("name")), F.struct(F.lit("tier").alias("what"), F.col("trust_tier").alias("name")), F.struct(F.lit("status").alias("what"), F.col("status").alias("name"))))
        return self.concepts.select("bundle", named.alias("g")).groupBy("bundle", "g.what", "g.name").agg(F.count("*").alias("n"))

    def save(self, path: str) -> None:
        """The main tables as Parquet, partitioned by bundle."""
        for name, table in (("concepts", self.concepts), ("links", self.links), ("sources", self.sources), ("contracts", self.contracts), ("attributions", self.attributions)):
            table.write.mode("overwrite").partitionBy("bundle").parquet(f"{path}/{name}")
