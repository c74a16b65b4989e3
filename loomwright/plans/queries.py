"""Registered queries over the written bundle, and their oracles in DuckDB SQL.

A query's key starts with the id of the operator it shows. Oracles know the bundle by the rules that wrote it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import concepts as typed_columns
from ..operators import diff, edits, graph, indexes, lint, logs, strict, validate
from ..operators.ordering import numbered_within, shared_folder
from ..sources.bundle import written_tree
from ..streaming import linked, snapshots
from . import forms, histories, render, tables
from .bundle import Bundle
from .corpus import LINK_SPAN, corpus_files

TODAY = "2026-07-01"
_bundles: dict[tuple, Bundle] = {}


def _kept(spark: SparkSession, sf_dir: str, what: str, files: Callable[[], DataFrame]) -> Bundle:
    """A bundle, parsed once for a session and folder; those of other folders are let go."""
    home = (spark.sparkContext.applicationId, sf_dir)
    for key in [k for k in _bundles if k[:2] != home]:
        old = _bundles.pop(key)
        if key[0] == home[0]:
            old.release(keep=True)
    if (*home, what) not in _bundles:
        _bundles[(*home, what)] = Bundle(files())
    return _bundles[(*home, what)]


def bundle_of(spark: SparkSession, sf_dir: str, edited: bool = False) -> Bundle:
    """The written bundle, or the later snapshot of it."""
    return _kept(spark, sf_dir, "edited" if edited else "plain", lambda: corpus_files(spark, sf_dir, edited))


def forms_of(spark: SparkSession, sf_dir: str) -> Bundle:
    """The bundle of unusual forms."""
    return _kept(spark, sf_dir, "forms", lambda: forms.forms_files(spark, sf_dir))


def histories_of(spark: SparkSession, sf_dir: str) -> Bundle:
    """The small bundles with logs and declared versions."""
    return _kept(spark, sf_dir, "histories", lambda: histories.history_files(spark, sf_dir))


def _history(make: Callable[[Bundle], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(histories_of(spark, sf_dir))


def _form(make: Callable[[Bundle], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(forms_of(spark, sf_dir))


def _query(make: Callable[[Bundle], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(bundle_of(spark, sf_dir))


def _diff(make: Callable[[DataFrame], DataFrame], *sections: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(bundle_of(spark, sf_dir).diff(bundle_of(spark, sf_dir, True), sections or diff.SECTIONS))


def _long(column):
    return column.cast("long") if not isinstance(column, str) else F.col(column).cast("long")


def _codes(found: DataFrame) -> DataFrame:
    return found.groupBy("code", "severity").agg(F.count("*").alias("n"))


def _concepts_in_order(b: Bundle) -> DataFrame:
    return numbered_within(b.concepts.select("bundle", "path_segs", "id"), "bundle", "path_segs").select("id", (F.col("number") + 1).alias("seq"))


def _forms_in_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of even numbers, then those of odd ones."""
    files = forms.forms_files(spark, sf_dir).where("rel_path <> 'index.md'")
    odd = F.regexp_extract("rel_path", r"(\d+)(/index)?\.md$", 1).try_cast("long") % 2
    return snapshots.arrivals(spark, [files.where(odd == k) for k in (0, 1)])


def _links_in_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the written bundle when its concepts arrive in three parts."""
    files = corpus_files(spark, sf_dir).where("rel_path not rlike '(^|/)(index|log)[.]md$'")
    part = F.regexp_extract("rel_path", r"(\d+)\.md$", 1).try_cast("long") % 3
    *_, last = linked.linked_steps(spark, [files.where(part == k) for k in range(3)])
    return last.select("src_id", "seq", "target_id", "exists", "raw")


def _late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the events in two parts by time. Of the first part every seventh event is late and comes with the second, which repeats
    every fifth event of both. A last event, ten years on, closes all sessions and is not one itself."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("long").alias("user_id"))
    half = events.agg(F.expr("timestamp_seconds(floor((unix_micros(min(ts)) + unix_micros(max(ts))) / 2e6))")).first()[0]
    first, late, again = F.col("ts") < F.lit(half), F.col("event_id") % 7 == 0, F.col("event_id") % 5 == 0
    second = events.where(~first | late).unionByName(events.where(again & ~(first & late)))
    last = events.agg((F.max("event_id") + 1).alias("event_id"), (F.max("ts") + F.expr("interval 10 years")).alias("ts")).withColumn("user_id", F.lit(-1).cast("long"))
    made = linked.session_table(spark, [events.where(first & ~late), second, last, last.where("false")])
    return made.select("user_id", F.date_format("began", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("began"), "n")


def _loaded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the later snapshot from tables that were refreshed from those of the first."""
    home = shared_folder(spark, "tables")
    first = tables.save(bundle_of(spark, sf_dir), f"{home}/first")
    later = first.refreshed(corpus_files(spark, sf_dir, True), f"{home}/later")
    return later.links().select("src_id", _long("seq").alias("seq"), "target_id", "exists", "raw")


def _changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a refresh from the first snapshot to the later one has to parse."""
    saved = tables.save(bundle_of(spark, sf_dir), f"{shared_folder(spark, 'tables')}/first")
    return saved.changed(corpus_files(spark, sf_dir, True)).select("rel_path")


def _graph_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and digest of the graph as one JSON file."""
    path = f"{shared_folder(spark, 'graph')}/graph.json"
    render.write_graph_json(bundle_of(spark, sf_dir), path, True)
    return spark.read.format("binaryFile").load(path).select(F.col("length").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha"))


def _edited(b: Bundle) -> DataFrame:
    """Every document with a new title, one key renamed, one removed and one set to a list, written out again."""
    own = edits.rename(edits.entries(), "description", "summary")
    own = edits.set_value(edits.remove(own, "tags"), "title", edits.value_of(F.concat(F.lit("Title: "), F.regexp_extract("id", r"(\d+)$", 1))))
    own = edits.set_value(own, "reviewers", edits.value_of(F.array(F.lit("ann"), F.lit("b: ob"), F.element_at("id_segs", 1))))
    return b.concepts.select("id", F.sha2(edits.document(own), 256).alias("sha"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s1_files_by_role": _query(lambda b: b.rows.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))),
    "s15_declared_version": _history(lambda b: b.version.select("bundle", "version")),
    "s17_log_entries": _history(lambda b: b.log_entries().select("bundle", _long("day").alias("day"), "date_text", _long("pos").alias("pos"), F.coalesce("kind", F.lit("-")).alias("kind"), "text")),
    "s19_directories": _query(lambda b: indexes.directories(b.files).select("dir", _long("depth").alias("depth"))),
    "o1_path_order": _query(_concepts_in_order),
    "p1_core_columns": _query(lambda b: b.concepts.select("id", F.coalesce("type", F.lit("-")).alias("type"), F.coalesce("title", F.lit("-")).alias("title"), "display_title", F.coalesce("description", F.lit("-")).alias("description"), F.array_join("tags", ",").alias("tags"))),
    "p5_latest_verification": _query(lambda b: b.concepts.select("id", F.coalesce("latest_verification.by", F.lit("-")).alias("by_whom"), F.coalesce("latest_verification.moment.text", F.lit("-")).alias("at_time"), F.coalesce("content_changed_at", F.lit("-")).alias("changed_at"))),
    "p7_status_and_staleness": _query(lambda b: b.concepts.select("id", "status", F.coalesce("stale_after.raw", F.lit("-")).alias("stale_raw"), F.coalesce(F.date_format("stale_after.effective", "yyyy-MM-dd"), F.lit("-")).alias("effective"))),
    "p9_trust_tiers": _query(lambda b: b.concepts.select("id", "trust_tier", _long("tier_rank").alias("tier_rank"))),
    "p11_contracts": _query(lambda b: b.contracts.select("id", "source", "code", "language", "runtime", _long(F.size("required_parameters")).alias("n_required"), "has_redundant_inline")),
    "p13_extension_and_legacy_keys": _query(lambda b: b.concepts.select("id", F.array_join("extension_keys", ",").alias("extension"), F.array_join("legacy_keys", ",").alias("legacy"))),
    "p14_preferred_key_order": _query(lambda b: typed_columns.reordered(b.concepts).select("id", F.array_join("keys", ",").alias("keys"))),
    "p3_sources": _query(lambda b: b.sources.select("src_id", _long("seq").alias("seq"), F.col("source.id").alias("source_id"), F.col("source.resource").alias("resource"), columns.resource_kind(F.col("source.resource")).alias("kind"))),
    "p10_contract_parts": _query(lambda b: b.contracts.select("id", F.explode("parameters").alias("p"), "executor", "attester").select("id", "p.name", "p.type", "p.required", F.col("executor.resource").alias("runs"), F.array_join("executor.receipt", ",").alias("receipt"), F.coalesce("attester.resource", F.lit("-")).alias("checks"))),
    "p12_path_fields": _query(lambda b: b.concepts.select("id", F.explode(typed_columns.path_fields()).alias("f")).select("id", "f.field", "f.raw")),
    "p18_id_parts": _query(lambda b: b.concepts.select("id", F.element_at("id_segs", -1).alias("name"), F.array_join(columns.parent(F.col("id_segs")), "/").alias("parent"), _long(F.size("id_segs")).alias("depth"))),
    "p19_actors": _query(lambda b: b.concepts.where("generated is not null").select("id", F.col("generated.by").alias("by_whom"), F.col("generated.by_kind").alias("kind"), F.substring_index("generated.by", "/", 1).alias("producer"), F.substring_index("generated.by", "/", -1).alias("version"))),
    "c8_path_candidates": _query(lambda b: b.sources.select("src_id", _long("seq").alias("seq"), F.array_join(columns.field_paths(F.col("source.resource"), F.col("src_segs")), "|").alias("ways"))),
    "c11_footnotes": _query(lambda b: b.footnotes().groupBy("id", "label", "is_def").agg(F.count("*").alias("n"))),
    "c21_citations": _query(lambda b: b.citations().select("id", _long("number").alias("number"), "text", "target", "raw")),
    "f9_valid_events": _query(lambda b: b.concepts.select("id", _long(F.size("verified")).alias("n_events"), _long(F.size(F.filter("verified", lambda v: v["valid"]))).alias("n_valid"))),
    "j16_point_lookups": _query(lambda b: b.links_from("d7/doc_7").select("target_id", "raw")),
    "s20_resolve_paths": _query(lambda b: b.resolve_paths(b.sources.where("source.id = 's1'").select("bundle", F.col("src_id").alias("id"), F.col("source.resource").alias("raw"))).select("id", F.coalesce("rel_path", F.lit("-")).alias("rel_path"))),
    "x8_candidates": _query(lambda b: graph.raw_links(b.concepts).select("src_id", _long("seq").alias("seq"), "kind", _long(F.size("candidates")).alias("n_candidates"))),
    "x3_common_ids": lambda spark, sf_dir: bundle_of(spark, sf_dir).concepts.select("id").intersect(bundle_of(spark, sf_dir, True).concepts.select("id")),
    "k10_graph_rows": _query(lambda b: render.graph_rows(b, True).select("id", _long(F.coalesce(F.size("links"), F.lit(0))).alias("n_links"), F.coalesce(F.array_join("links.target", ","), F.lit("")).alias("targets"), F.coalesce(F.array_join("sources", ","), F.lit("")).alias("sources"))),
    "k13_diagnostic_lines": _query(lambda b: validate.unresolved_paths(b.concepts, b.files).select(render.diagnostic_line().alias("line"))),
    "f1_concepts_of_type": _query(lambda b: b.of_type("Metric").select("id")),
    "f3_stale_on": _query(lambda b: b.stale_on(TODAY).select("id")),
    "f4_broken_links": _query(lambda b: b.broken_links().select("src_id", "raw")),
    "f5_totals": _query(lambda b: b.totals(TODAY).select("errors", "warnings", "infos", "conformant")),
    "c1_link_kinds": _query(lambda b: graph.raw_links(b.concepts).groupBy("kind").agg(F.count("*").alias("n"))),
    "j1_resolve_links": _query(lambda b: b.links.select("src_id", _long("seq").alias("seq"), "target_id", "exists", "raw")),
    "j2_derivations": _query(lambda b: graph.derivations(b.sources).select("src_id", "concept_id")),
    "j3_attributions": _query(lambda b: b.attributions.select("id", _long("ord").alias("ord"), "label", _long("n_refs").alias("n_refs"), _long("n_defs").alias("n_defs"), F.col("source").isNotNull().alias("resolved"))),
    "j15_computation_users": _query(lambda b: b.contracts.join(b.backlinks().select(F.col("target_id").alias("id"), "src_id"), "id", "left").groupBy("id").agg(F.count("src_id").alias("n_users"))),
    "a1_backlinks": _query(lambda b: b.backlinks().groupBy("target_id").agg(F.count("*").alias("n"), F.min("src_id").alias("first_src"))),
    "a2_derived_by": _query(lambda b: graph.derived_by(b.sources).groupBy("concept_id").agg(F.count("*").alias("n"))),
    "a3_tags": _query(lambda b: graph.tag_edges(b.concepts).groupBy("tag").agg(F.count("*").alias("n"), F.min_by("id", F.struct("path_segs", "pos")).alias("first_id"))),
    "a5_groups": _query(lambda b: b.groups().select("what", "name", "n")),
    "a6_summary": _query(lambda b: b.summary(TODAY).select("measure", "value")),
    "a8_validate_codes": _query(lambda b: _codes(b.validate(TODAY))),
    "a8_lint_codes": _query(lambda b: _codes(b.lint(TODAY))),
    "v15_unresolved_paths": _query(lambda b: validate.unresolved_paths(b.concepts, b.files).select("concept", "message")),
    "v20_broken_link_findings": _query(lambda b: validate.broken(b.links).select("concept", "message")),
    "l9_stale_verifications": _query(lambda b: b.lint(TODAY, ("L9",)).select("concept", "message")),
    "l10_deprecated_links": _query(lambda b: lint.deprecated_links(b.concepts, b.links).select("concept", "message")),
    "l13_self_links": _query(lambda b: lint.self_links(b.concepts, b.links).select("concept")),
    "l14_duplicate_titles": _query(lambda b: lint.shared_titles(b.concepts).select("concept", "message")),
    "l15_orphans": _query(lambda b: lint.orphans(b.concepts, b.links, graph.index_listings(b.indexes)).select("concept")),
    "l16_stale_indexes": _query(lambda b: lint.stale_indexes(b.concepts, b.indexes, graph.index_listings(b.indexes)).select("path", "message")),
    "w1_log_order": _history(lambda b: logs.out_of_order(logs.days(logs.lines(b.logs))).select("bundle", "date_text", "before")),
    "w2_log_problems": _history(lambda b: logs.problems(b.logs).select("bundle", "message")),
    "w9_node_numbers": _query(lambda b: render.node_numbers(b).select("id", _long("n").alias("n"))),
    "k1_serialized": _query(lambda b: b.concepts.select("id", F.sha2("serialized", 256).alias("sha"))),
    "k5_index_entries": _query(lambda b: indexes.entries(b.rows, b.files).select("dir", "type", "title", "link", "description")),
    "k6_index_texts": _query(lambda b: b.index_texts().select("rel_path", "content")),
    "k8_graph_text": _query(lambda b: render.graph_text(b, True).select(F.array_join("path_segs", "/").alias("path"), _long("part").alias("part"), _long("seq").alias("seq"), "line")),
    "k9_graph_mermaid": _query(lambda b: render.graph_mermaid(b, True).select(_long("part").alias("part"), _long("a").alias("a"), _long("b").alias("b"), _long("c").alias("c"), "line")),
    "k11_log_markdown": _history(lambda b: logs.to_markdown(b.logs).select("bundle", "markdown")),
    "v17_reserved_files": _history(lambda b: validate.reserved_files(b.rows).select("bundle", "code", "message").unionByName(validate.version_rule(b.rows).select("bundle", "code", "message"))),
    "x1_added_and_removed": _diff(lambda d: d.select("section", "id"), "added", "removed"),
    "j12_renames": _diff(lambda d: d.select("old", "new"), "renamed"),
    "j11_changed_bodies": _diff(lambda d: d.select("id"), "content"),
    "j13_frontmatter_diff": _diff(lambda d: d.select("id", "kind", "key", F.coalesce("old", F.lit("-")).alias("old"), F.coalesce("new", F.lit("-")).alias("new")), "frontmatter"),
    "j14_trust_diff": _diff(lambda d: d.select("id", "kind", "old", "new"), "trust"),
    "x4_link_diff": _diff(lambda d: d.select("section", "id", F.col("key").alias("to")), *diff.SECTIONS[-4:]),
    "a14_diff_size": _diff(lambda d: diff.size(d)),
    "stream_log_entries": lambda spark, sf_dir: snapshots.log_table(spark, histories.history_files(spark, sf_dir).where("rel_path = 'log.md'")).groupBy("date_text").agg(F.count("*").alias("n")),
    "stream_concept_types": lambda spark, sf_dir: snapshots.type_table(spark, corpus_files(spark, sf_dir).where("rel_path not rlike '(^|/)(index|log)[.]md$'")).select("type", "n"),
    "s2_tree_load": lambda spark, sf_dir: written_tree(forms.forms_files(spark, sf_dir)).select("rel_path", F.decode("content", "utf-8").alias("content")),
    "f13_segments": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("n"), F.coalesce(F.array_join(columns.valid_id(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 12)), "|"), F.lit("-")).alias("steps")),
    "d2_epoch_days": _query(lambda b: b.rows.where("role = 'concept'").select("id", F.try_element_at("node", F.lit("stale_after"))["moment"]["day"].cast("long").alias("day")).where("day is not null")),
    "k14_moment_texts": _form(lambda b: b.concepts.select("id", F.posexplode("verified").alias("seq", "v")).select("id", _long("seq").alias("seq"), F.col("v.moment.text").alias("shown"))),
    "s18_index_rows": _form(lambda b: indexes.file_rows(b.rows).select(F.regexp_replace(F.concat_ws("/", "dir", "name"), r"\.md$", "").alias("id"), "type")),
    "p4_usage_windows": _form(lambda b: b.concepts.where("usage_window is not null").select("id", F.col("usage_window.from.raw").alias("since"), F.col("usage_window.to.raw").alias("until"))),
    "o5_directory_order": _form(lambda b: numbered_within(indexes.directories(b.files).withColumn("up", -F.col("depth")), "bundle", "up", "dir_segs").select("dir", (F.col("number") + 1).alias("seq"))),
    "k10_graph_file": _graph_file,
    "j1_loaded_tables": _loaded_links,
    "s4_changed_files": _changed_files,
    "j1_stream_links": _links_in_steps,
    "stream_late_sessions": _late_sessions,
    "p15_edited_documents": _query(_edited),
    "f15_document_errors": _query(lambda b: b.concepts.select("id", strict.document_error().alias("error")).where("error is not null")),
    "s2_tree_stream": lambda spark, sf_dir: _forms_in_steps(spark, sf_dir).select("rel_path", F.decode("content", "utf-8").alias("content"), "step"),
    "k7_written_indexes": lambda spark, sf_dir: written_tree(bundle_of(spark, sf_dir).index_texts().withColumn("content", F.encode("content", "utf-8"))).select("rel_path", F.decode("content", "utf-8").alias("content")),
    "k4_written_documents": lambda spark, sf_dir: written_tree(bundle_of(spark, sf_dir).concepts.select("bundle", "rel_path", F.encode("serialized", "utf-8").alias("content"))).select(F.regexp_replace("rel_path", r"\.md$", "").alias("id"), F.sha2("content", 256).alias("sha")),
    "c2_link_forms": _form(lambda b: b.links.select(F.col("src_id").alias("id"), _long("seq").alias("seq"), "text", "raw", F.col("target_id").alias("target"), "exists")),
    "p16_value_forms": _form(lambda b: b.concepts.where(r"id rlike '^v(9|1[0-5])/'").select("id", F.coalesce("title", F.lit("-")).alias("title"), F.coalesce("description", F.lit("-")).alias("description"), F.array_join("tags", "|").alias("tags"))),
    "v1_unreadable_files": _form(lambda b: validate.unparsed(b.rows).select(F.regexp_replace("path", r"\.md$", "").alias("id"), "path", "message")),
    "v5_odd_values": _form(lambda b: b.validate().where("code in ('V5', 'V9', 'V10', 'V16', 'V17')").select(F.regexp_replace("path", r"\.md$", "").alias("id"), "code", "message")),
    "l7_body_forms": _form(lambda b: b.lint(None, ("L7", "L8")).select(F.col("concept").alias("id"), "code")),
    "l15_orphan_forms": _form(lambda b: lint.orphans(b.concepts, b.links, graph.index_listings(b.indexes)).select(F.col("concept").alias("id"))),
    "k1_written_forms": _form(lambda b: b.concepts.where(r"id rlike '^v1[1-6]/'").select("id", "serialized")),
    "d4_latest_instants": _form(lambda b: b.concepts.where("latest_verification is not null").select("id", F.col("latest_verification.by").alias("by_whom"), F.col("latest_verification.moment.text").alias("at_time"))),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


# --- oracles

_PRELUDE = f"""WITH d AS (SELECT doc_id::BIGINT AS n, lang FROM documents),
a AS (SELECT n, lang, 'd' || (n % 10) || '/doc_' || n AS id, n % 53 <> 0 AS typed,
  CASE WHEN n % 53 = 0 THEN '-' WHEN n % 7 = 0 THEN 'Attested Computation' WHEN n % 5 = 0 THEN 'Metric' ELSE 'Note' END AS type,
  CASE WHEN n % 43 = 0 THEN '-' WHEN n % 41 = 0 THEN 'Shared title' ELSE 'Document ' || n END AS title,
  CASE WHEN n % 6 = 0 THEN '-' ELSE 'About ' || n END AS description,
  CASE WHEN n % 8 = 0 THEN 'draft' WHEN n % 8 = 1 THEN 'deprecated' WHEN n % 8 = 2 THEN 'experimental' ELSE 'stable' END AS status,
  CASE WHEN n % 3 = 2 OR n % 31 = 0 THEN 0 WHEN n % 3 = 0 THEN 2 ELSE 1 END AS tier,
  CASE WHEN n % 37 = 0 THEN 'soon' WHEN n % 4 = 0 THEN '2026-06-' || (10 + n % 20) WHEN n % 4 = 1 THEN '2026-08-15T00:00:00Z' ELSE '-' END AS stale,
  CASE WHEN n % 37 = 0 THEN '-' WHEN n % 4 = 0 THEN '2026-06-' || (10 + n % 20) WHEN n % 4 = 1 THEN '2026-08-15' ELSE '-' END AS effective FROM d),
b AS (SELECT n, CASE WHEN n % 50 = 1 THEN 'd' || (n % 10) || '/moved_' || n ELSE 'd' || (n % 10) || '/doc_' || n END AS id FROM d WHERE n % 50 <> 0),
made AS (SELECT n, 0 AS seq, 'd' || ((n * 7 + 3) % {LINK_SPAN} % 10) || '/doc_' || ((n * 7 + 3) % {LINK_SPAN}) AS target, '/d' || ((n * 7 + 3) % {LINK_SPAN} % 10) || '/doc_' || ((n * 7 + 3) % {LINK_SPAN}) || '.md' AS raw FROM d
  UNION ALL SELECT n, 1, 'd' || ((n + 1) % 10) || '/doc_' || (n + 1), '../d' || ((n + 1) % 10) || '/doc_' || (n + 1) || '.md#part' FROM d
  UNION ALL SELECT n, 2, 'gone/x' || n, '/gone/x' || n || '.md' FROM d WHERE n % 20 = 0
  UNION ALL SELECT n, CASE WHEN n % 20 = 0 THEN 3 ELSE 2 END, 'd' || (n % 10) || '/doc_' || n, 'doc_' || n || '.md' FROM d WHERE n % 97 = 0),
links AS (SELECT a.id AS src_id, a.n AS n, m.seq, m.target, m.raw, t.id IS NOT NULL AS ok FROM made m JOIN a ON a.n = m.n LEFT JOIN a t ON t.id = m.target),
links_b AS (SELECT b.id AS src_id, b.n AS n, m.seq, m.target, m.raw, t.id IS NOT NULL AS ok FROM made m JOIN b ON b.n = m.n LEFT JOIN b t ON t.id = m.target),
derived AS (SELECT s.id AS src_id, t.id AS concept_id FROM a s JOIN a t ON t.n = s.n + 1 WHERE s.n % 5 = 0),
listed AS (SELECT n, id FROM a WHERE n % 10 < 5 AND n % 3 <> 0),
tagged AS (SELECT n, id, lang AS tag, 0 AS pos FROM a WHERE n % 29 <> 0 UNION ALL SELECT n, id, 's' || (n % 4), 1 FROM a WHERE n % 29 <> 0),
stale_now AS (SELECT * FROM a WHERE effective <> '-' AND effective <= '{TODAY}'),
logs AS (SELECT range AS k FROM range(10)),
days AS (SELECT k, 1 AS day, '2026-02-0' || (1 + k % 9) AS date_text, 'New' AS kind, 'a' || k AS text FROM logs UNION ALL SELECT k, 2, '2026-01-15', '-', 'b' FROM logs
  UNION ALL SELECT k, 3, '2026-03-01', '-', 'c' FROM logs WHERE k % 3 = 0 UNION ALL SELECT k, CASE WHEN k % 3 = 0 THEN 4 ELSE 3 END, 'soon', '-', 'd' FROM logs WHERE k % 4 = 0),
keys AS (SELECT id, n, list_filter(['type', 'title', 'description', 'tags', 'generated', 'verified', 'status', 'stale_after', 'sources', 'timestamp', 'runtime', 'parameters', 'executor', 'attester'],
  lambda k: CASE k WHEN 'type' THEN n % 53 <> 0 WHEN 'title' THEN n % 43 <> 0 WHEN 'description' THEN n % 6 <> 0 WHEN 'generated' THEN n % 9 <> 0 WHEN 'verified' THEN n % 3 < 2 WHEN 'status' THEN n % 8 <> 3
  WHEN 'stale_after' THEN n % 37 = 0 OR n % 4 < 2 WHEN 'sources' THEN n % 5 = 0 WHEN 'timestamp' THEN n % 45 = 0 WHEN 'tags' THEN TRUE WHEN 'attester' THEN n % 7 = 0 AND n % 14 <> 0 ELSE n % 7 = 0 END) AS k FROM a)
"""  # fmt: skip

_COUNTS = {
    "L1": ("warning", "n % 43 = 0"), "L2": ("warning", "n % 6 = 0"), "L3": ("warning", "n % 9 = 0 AND n % 45 <> 0"), "L4": ("info", "n % 3 = 2"), "L5": ("warning", "n % 45 = 0"),
    "L6": ("warning", "n % 11 = 0"), "L9": ("warning", "tier > 0 AND n % 9 <> 0 AND n % 20 <= n % 17"), "L12": ("info", "status = 'draft'"), "L13": ("info", "n % 97 = 0"),
}


def _union(rows: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{code}' AS code, '{sev}' AS severity, count(*) AS n FROM a WHERE {cond}" for code, (sev, cond) in rows.items())


_LISTED_OR_LINKED = "SELECT id FROM a WHERE id NOT IN (SELECT target FROM links WHERE ok) AND id NOT IN (SELECT id FROM listed)"
_SHARED = "SELECT id FROM a WHERE title IN (SELECT title FROM a WHERE title <> '-' GROUP BY title HAVING count(*) > 1)"
_DEPRECATED = "SELECT DISTINCT l.src_id, l.target FROM links l JOIN a t ON t.id = l.target WHERE l.ok AND t.status = 'deprecated'"
_OUT_OF_ORDER = "SELECT k, '2026-03-01' AS date_text, '2026-01-15' AS before FROM logs WHERE k % 3 = 0"
_LOG_PROBLEMS = f"""SELECT 'd' || k || '/log.md' AS rel_path, 'log date groups are not newest first: "' || date_text || '" follows "' || before || '"' AS message FROM ({_OUT_OF_ORDER})
UNION ALL SELECT 'd' || k || '/log.md', 'log date heading is not ISO-8601 `YYYY-MM-DD`: "soon"' FROM logs WHERE k % 4 = 0
UNION ALL SELECT 'd' || k || '/log.md', 'log contains non-log content at line ' || (7 + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END) FROM logs WHERE k % 5 = 0"""
_V15 = "SELECT id AS concept, '`executor.resource` does not resolve to a file in the bundle: run.md (§6.2)' AS message FROM a WHERE n % 7 = 0 UNION ALL SELECT id, '`attester.resource` does not resolve to a file in the bundle: check.py (§6.2)' FROM a WHERE n % 7 = 0 AND n % 14 <> 0"
_LINK_DIFF = """SELECT DISTINCT 'added_links' AS section, src_id AS id, target AS "to" FROM links_b x WHERE ok AND NOT EXISTS (SELECT 1 FROM links y WHERE y.ok AND y.src_id = x.src_id AND y.target = x.target)
UNION ALL SELECT DISTINCT 'removed_links', src_id, target FROM links x WHERE ok AND NOT EXISTS (SELECT 1 FROM links_b y WHERE y.ok AND y.src_id = x.src_id AND y.target = x.target)
UNION ALL SELECT DISTINCT 'mended_links', src_id, raw FROM links x WHERE NOT ok AND NOT EXISTS (SELECT 1 FROM links_b y WHERE NOT y.ok AND y.src_id = x.src_id AND y.raw = x.raw)
UNION ALL SELECT DISTINCT 'broken_links', src_id, raw FROM links_b x WHERE NOT ok AND NOT EXISTS (SELECT 1 FROM links y WHERE NOT y.ok AND y.src_id = x.src_id AND y.raw = x.raw)"""
_ARCHIVED = "SELECT id, status FROM a WHERE n % 50 = 3"
_FRONT_DIFF = f"""SELECT id, CASE WHEN n % 8 = 3 THEN 'added' ELSE 'changed' END AS kind, 'status' AS key, CASE WHEN n % 8 = 3 THEN '-' ELSE status END AS "old", CASE WHEN n % 8 = 3 THEN '-' ELSE 'archived' END AS "new" FROM a WHERE n % 50 = 3
UNION ALL SELECT id, 'added', 'owner', '-', '-' FROM a WHERE n % 50 = 4"""
_FILES = """SELECT 'd' || (n % 10) AS dir, CASE WHEN typed THEN type ELSE '' END AS type, CASE WHEN title = '-' THEN 'doc_' || n ELSE title END AS title, 'doc_' || n || '.md' AS link, CASE WHEN description = '-' THEN '' ELSE description END AS description, 'doc_' || n || '.md' AS name FROM a
UNION ALL SELECT 'd' || k, '', 'log', 'log.md', '', 'log.md' FROM logs"""
_ENTRIES = f"""SELECT * FROM files UNION ALL SELECT '' AS dir, 'Subdirectories' AS type, dir AS title, dir || '/index.md' AS link, CASE WHEN count(*) = 1 AND max(description) <> '' THEN max(description) ELSE 'Contains ' || count(*) || ' entries: ' || string_agg(title, ', ' ORDER BY name) || '.' END AS description, dir AS name FROM files GROUP BY dir"""
_NODES = """SELECT id, (row_number() OVER (ORDER BY dir, file, seq)) - 1 AS n FROM (SELECT id, first(dir ORDER BY dir, file, seq) AS dir, first(file ORDER BY dir, file, seq) AS file, first(seq ORDER BY dir, file, seq) AS seq FROM
(SELECT id, 'd' || (n % 10) AS dir, 'doc_' || n || '.md' AS file, -1 AS seq FROM a UNION ALL SELECT target, 'd' || (n % 10), 'doc_' || n || '.md', seq FROM links) GROUP BY id)"""

_NL = "chr(10)"
#: The normal form of a document, from its number: every collection in block style, moments quoted.
_FRONT_LINES = [
    "CASE WHEN typed THEN 'type: ' || type END",
    "CASE WHEN title <> '-' THEN 'title: ' || title END",
    "CASE WHEN description <> '-' THEN 'description: ' || description END",
    f"CASE WHEN n % 29 = 0 THEN 'tags: ' || lang ELSE 'tags:' || {_NL} || '  - ' || lang || {_NL} || '  - s' || (n % 4) END",
    f"CASE WHEN n % 9 <> 0 THEN 'generated:' || {_NL} || '  by: writer/1.0' || {_NL} || '  at: \"2026-05-' || (10 + n % 17) || 'T08:00:00Z\"' END",
    f"CASE WHEN n % 3 < 2 THEN 'verified:' || {_NL} || '  - by: ' || CASE WHEN n % 3 = 0 THEN 'human:reviewer' ELSE 'process:nightly' END || {_NL} || '    at: ' || CASE WHEN n % 31 = 0 THEN '2026-05-' || (10 + n % 20) ELSE '\"2026-05-' || (10 + n % 20) || 'T00:00:00Z\"' END END",
    "CASE WHEN n % 8 <> 3 THEN 'status: ' || status END",
    "CASE WHEN stale LIKE '%T%' THEN 'stale_after: \"' || stale || '\"' WHEN stale <> '-' THEN 'stale_after: ' || stale END",
    f"CASE WHEN n % 5 = 0 THEN 'sources:' || {_NL} || '  - id: s1' || {_NL} || '    resource: ../d' || ((n + 1) % 10) || '/doc_' || (n + 1) || '.md' || {_NL} || '  - id: s2' || {_NL} || '    resource: https://example.com/' || n END",
    "CASE WHEN n % 45 = 0 THEN 'timestamp: \"2026-05-01T00:00:00Z\"' END",
    f"CASE WHEN n % 7 = 0 THEN 'runtime: sql' || {_NL} || 'parameters:' || {_NL} || '  - name: year' || {_NL} || '    type: integer' || {_NL} || '    required: true' || {_NL} || 'executor:' || {_NL} || '  resource: run.md' || {_NL} || '  receipt:' || {_NL} || '    - log' || CASE WHEN n % 14 = 0 THEN '' ELSE {_NL} || 'attester:' || {_NL} || '  resource: check.py' END END",
]
_BODY_LINES = [
    f"'# Document ' || n || {_NL} || {_NL} || coalesce(text, '') || {_NL}",
    f"'[next](/d' || ((n * 7 + 3) % {LINK_SPAN} % 10) || '/doc_' || ((n * 7 + 3) % {LINK_SPAN}) || '.md) [peer](../d' || ((n + 1) % 10) || '/doc_' || (n + 1) || '.md#part)'",
    "CASE WHEN n % 20 = 0 THEN '[gone](/gone/x' || n || '.md)' END",
    "CASE WHEN n % 97 = 0 THEN '[me](doc_' || n || '.md)' END",
    f"CASE WHEN n % 5 = 0 THEN {_NL} || 'Claim[^s1] and other[^zz].' || {_NL} || {_NL} || '[^s1]: first source' END",
    f"CASE WHEN n % 11 = 0 THEN {_NL} || '# Citations' || {_NL} || {_NL} || '[1] [Site](https://example.com/' || n || ')' END",
    f"CASE WHEN n % 7 = 0 THEN {_NL} || '# Computation' || {_NL} || {_NL} || '```sql' || {_NL} || 'SELECT ' || n || {_NL} || '```' END",
]
_WRITTEN = f"'---' || {_NL} || concat_ws({_NL}, {', '.join(_FRONT_LINES)}) || {_NL} || '---' || {_NL} || {_NL} || concat_ws({_NL}, {', '.join(_BODY_LINES)}) || {_NL}"

_SEGMENTS = r"""SELECT doc_id::BIGINT AS n, CASE WHEN len(list_filter(s, lambda x: x IN ('', '.', '..') OR regexp_matches(x, '[/\\]|\p{Cc}'))) > 0 THEN '-' ELSE array_to_string(s, '|') END AS steps
FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ')[1:12] AS s FROM documents)"""

#: Late rows are those of the first part that the watermark has passed when the second comes.
_SESSIONS = """WITH e AS (SELECT event_id, ts, user_id FROM events), m AS (SELECT make_timestamp((floor((epoch_us(min(ts)) + epoch_us(max(ts))) / 2e6) * 1000000)::BIGINT) AS half FROM e),
first AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM e, m WHERE ts < half AND event_id % 7 <> 0),
kept AS (SELECT e.* FROM e, m, first WHERE ts >= half OR event_id % 7 <> 0 OR ts > mark),
gaps AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM gaps)
SELECT user_id::BIGINT AS user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS began, count(*) AS n FROM numbered GROUP BY user_id, k"""

_EDITED = [
    _FRONT_LINES[0], "CASE WHEN title <> '-' THEN 'title: \"Title: ' || n || '\"' END", _FRONT_LINES[2].replace("'description: '", "'summary: '"), *_FRONT_LINES[4:],
    "CASE WHEN title = '-' THEN 'title: \"Title: ' || n || '\"' END", f"'reviewers:' || {_NL} || '  - ann' || {_NL} || '  - \"b: ob\"' || {_NL} || '  - d' || (n % 10)",
]

_FORM_ORACLES: dict[str, str] = {
    "s2_tree_load": "SELECT rel_path, content FROM (" + forms.expected(tuple((v, *f) for v, f in enumerate(forms.FORMS)), "rel_path", "content") + ") UNION ALL SELECT 'index.md', '---\nokf_version: \"0.2\"\n---\n\n# Parts\n'",
    "s2_tree_stream": "SELECT rel_path, content, step FROM (" + forms.expected(tuple((v, *f) for v, f in enumerate(forms.FORMS)), "rel_path", "content").replace("SELECT CASE", "SELECT (d.doc_id % 2)::BIGINT AS step, CASE", 1) + ")",
    "k14_moment_texts": forms.expected(((16, 0, "2026-06-20T09:00:00+02:00"), (16, 1, "2026-06-20T07:30:00Z"), (16, 2, "2026-06-20T06:59:59.5Z")), "seq", "shown").replace('e."seq"', 'e."seq"::BIGINT AS "seq"'),
    "s18_index_rows": forms.expected(tuple((v, "Note") for v in range(len(forms.FORMS)) if v != 25 and v not in {b[0] for b in forms.BROKEN}), "type"),
    "p4_usage_windows": forms.expected(((21, "2026-01-01", "2026-02-01"), (30, "soon", "later{n}")), "since", "until"),
    "o5_directory_order": f"""SELECT dir, row_number() OVER (ORDER BY -depth, dir) AS seq FROM (SELECT DISTINCT dir, CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS depth FROM (
        SELECT '' AS dir UNION ALL SELECT 'v' || (doc_id % {len(forms.FORMS)}) FROM documents UNION ALL SELECT 'v25/n' || doc_id FROM documents WHERE doc_id % {len(forms.FORMS)} = 25
        UNION ALL SELECT unnest(['v8/a', 'v8/a/b', 'v8/a/b/c']) FROM documents WHERE doc_id % {len(forms.FORMS)} = 8))""",
    "c2_link_forms": forms.expected(forms.LINKS, "seq", "text", "raw", "target", "exists").replace('e."seq"', 'e."seq"::BIGINT AS "seq"'),
    "p16_value_forms": forms.expected(forms.VALUES, "title", "description", "tags"),
    "v1_unreadable_files": forms.expected(forms.BROKEN, "path", "message"),
    "v5_odd_values": forms.expected(forms.FINDINGS, "code", "message"),
    "l7_body_forms": forms.expected(forms.BODIES, "code"),
    "l15_orphan_forms": forms.expected(tuple((v,) for v in forms.ORPHANS)),
    "k1_written_forms": forms.expected(forms.WRITTEN, "serialized"),
    "d4_latest_instants": forms.expected(((16, "process:b", "2026-06-20T07:30:00Z"),), "by_whom", "at_time"),
}

_ORACLES: dict[str, str] = {
    "j1_loaded_tables": "SELECT src_id, seq::BIGINT AS seq, target AS target_id, n2.id IS NOT NULL AS \"exists\", raw FROM links_b l LEFT JOIN b n2 ON n2.id = l.target",
    "s4_changed_files": "SELECT id || '.md' AS rel_path FROM b WHERE n % 50 BETWEEN 1 AND 4 UNION ALL SELECT 'd0/index.md' WHERE EXISTS (SELECT 1 FROM listed WHERE n % 50 = 0)",
    "k10_graph_file": """SELECT strlen(t)::BIGINT AS n_bytes, sha256(t) AS sha FROM (SELECT '{' || chr(10) || '  "concepts": [' || chr(10) || string_agg(block, ',' || chr(10) ORDER BY 'd' || (n % 10), 'doc_' || n || '.md') || chr(10) || '  ]' || chr(10) || '}' || chr(10) AS t FROM (
        SELECT a.n, '    {' || chr(10) || '      "id": "' || a.id || '",' || chr(10) || '      "links": [' || chr(10) || string_agg('        {' || chr(10) || '          "target": "' || l.target || '",' || chr(10) || '          "exists": ' || l.ok || ',' || chr(10) || '          "text": "' ||
        CASE WHEN l.raw LIKE '/gone/%' THEN 'gone' WHEN l.raw LIKE '/%' THEN 'next' WHEN l.raw LIKE '../%' THEN 'peer' ELSE 'me' END || '",' || chr(10) || '          "raw": "' || l.raw || '"' || chr(10) || '        }', ',' || chr(10) ORDER BY l.seq) || chr(10) || '      ],' || chr(10) || '      "sources": [' || coalesce('"' || max(d.concept_id) || '"', '') || ']' || chr(10) || '    }' AS block
        FROM a JOIN links l ON l.src_id = a.id LEFT JOIN derived d ON d.src_id = a.id GROUP BY a.n, a.id))""",
    "d2_epoch_days": "SELECT id, datediff('day', DATE '1970-01-01', CAST(effective AS DATE))::BIGINT AS day FROM a WHERE effective <> '-'",
    "p15_edited_documents": f"SELECT id, sha256({_WRITTEN.replace(', '.join(_FRONT_LINES), ', '.join(_EDITED))}) AS sha FROM (SELECT a.*, d.text FROM a JOIN documents d ON d.doc_id = a.n)",
    "f15_document_errors": "SELECT id, 'Missing required frontmatter keys: type' AS error FROM a WHERE n % 53 = 0",
    "s1_files_by_role": "SELECT 'concept' AS role, count(*) AS n, 0::BIGINT AS n_errors FROM a UNION ALL SELECT 'log', 10, 0 UNION ALL SELECT 'index', 1 + count(DISTINCT n % 10), 0 FROM listed",
    "s19_directories": "SELECT '' AS dir, 0::BIGINT AS depth UNION ALL SELECT 'd' || k, 1 FROM logs",
    "o1_path_order": "SELECT id, row_number() OVER (ORDER BY 'd' || (n % 10), 'doc_' || n || '.md') AS seq FROM a",
    "p1_core_columns": "SELECT id, type, title, CASE WHEN title = '-' THEN 'doc_' || n ELSE title END AS display_title, description, CASE WHEN n % 29 = 0 THEN '' ELSE lang || ',s' || (n % 4) END AS tags FROM a",
    "p5_latest_verification": "SELECT id, CASE tier WHEN 0 THEN '-' WHEN 2 THEN 'human:reviewer' ELSE 'process:nightly' END AS by_whom, CASE WHEN tier = 0 THEN '-' ELSE '2026-05-' || (10 + n % 20) || 'T00:00:00Z' END AS at_time, CASE WHEN n % 9 <> 0 THEN '2026-05-' || (10 + n % 17) || 'T08:00:00Z' WHEN n % 45 = 0 THEN '2026-05-01T00:00:00Z' ELSE '-' END AS changed_at FROM a",
    "p7_status_and_staleness": "SELECT id, status, stale AS stale_raw, effective FROM a",
    "p9_trust_tiers": "SELECT id, ['unverified', 'machine-confirmed', 'human-reviewed'][tier + 1] AS trust_tier, tier::BIGINT AS tier_rank FROM a",
    "p11_contracts": "SELECT id, 'inline' AS source, 'SELECT ' || n AS code, 'sql' AS language, 'sql' AS runtime, 1::BIGINT AS n_required, FALSE AS has_redundant_inline FROM a WHERE type = 'Attested Computation'",
    "p13_extension_and_legacy_keys": "SELECT id, '' AS extension, CASE WHEN n % 45 = 0 THEN 'timestamp' ELSE '' END AS legacy FROM a",
    "p14_preferred_key_order": "SELECT id, array_to_string(list_concat(list_filter(['type', 'resource', 'title', 'description', 'tags', 'status', 'generated', 'verified', 'stale_after', 'sources', 'usage_window'], lambda p: list_contains(k, p)), list_filter(k, lambda x: NOT list_contains(['type', 'resource', 'title', 'description', 'tags', 'status', 'generated', 'verified', 'stale_after', 'sources', 'usage_window'], x))), ',') AS keys FROM keys",
    "p3_sources": "SELECT id AS src_id, 0::BIGINT AS seq, 's1' AS source_id, '../d' || ((n + 1) % 10) || '/doc_' || (n + 1) || '.md' AS resource, 'path' AS kind FROM a WHERE n % 5 = 0 UNION ALL SELECT id, 1, 's2', 'https://example.com/' || n, 'url' FROM a WHERE n % 5 = 0",
    "p10_contract_parts": "SELECT id, 'year' AS name, 'integer' AS type, TRUE AS required, 'run.md' AS runs, 'log' AS receipt, CASE WHEN n % 14 = 0 THEN '-' ELSE 'check.py' END AS checks FROM a WHERE type = 'Attested Computation'",
    "p12_path_fields": "SELECT id, 'executor.resource' AS field, 'run.md' AS raw FROM a WHERE n % 7 = 0 UNION ALL SELECT id, 'attester.resource', 'check.py' FROM a WHERE n % 7 = 0 AND n % 14 <> 0",
    "p18_id_parts": "SELECT id, 'doc_' || n AS name, 'd' || (n % 10) AS parent, 2::BIGINT AS depth FROM a",
    "p19_actors": "SELECT id, 'writer/1.0' AS by_whom, 'agent' AS kind, 'writer' AS producer, '1.0' AS version FROM a WHERE n % 9 <> 0",
    "c8_path_candidates": "SELECT id AS src_id, 0::BIGINT AS seq, 'd' || ((n + 1) % 10) || '/doc_' || (n + 1) || '.md' AS ways FROM a WHERE n % 5 = 0 UNION ALL SELECT id, 1, '' FROM a WHERE n % 5 = 0",
    "c11_footnotes": "SELECT id, 's1' AS label, FALSE AS is_def, 1::BIGINT AS n FROM a WHERE n % 5 = 0 UNION ALL SELECT id, 'zz', FALSE, 1 FROM a WHERE n % 5 = 0 UNION ALL SELECT id, 's1', TRUE, 1 FROM a WHERE n % 5 = 0",
    "c21_citations": "SELECT id, 1::BIGINT AS number, 'Site' AS text, 'https://example.com/' || n AS target, '[Site](https://example.com/' || n || ')' AS raw FROM a WHERE n % 11 = 0",
    "f9_valid_events": "SELECT id, CASE WHEN n % 3 < 2 THEN 1 ELSE 0 END::BIGINT AS n_events, CASE WHEN tier > 0 THEN 1 ELSE 0 END::BIGINT AS n_valid FROM a",
    "j16_point_lookups": "SELECT target AS target_id, raw FROM links WHERE src_id = 'd7/doc_7'",
    "s20_resolve_paths": "SELECT a.id, coalesce(t.id || '.md', '-') AS rel_path FROM a LEFT JOIN a t ON t.n = a.n + 1 WHERE a.n % 5 = 0",
    "x8_candidates": "SELECT src_id, seq::BIGINT AS seq, CASE WHEN raw LIKE '/%' THEN 'absolute' ELSE 'relative' END AS kind, 1::BIGINT AS n_candidates FROM links UNION ALL SELECT id, 2 + CASE WHEN n % 20 = 0 THEN 1 ELSE 0 END + CASE WHEN n % 97 = 0 THEN 1 ELSE 0 END, 'external', 0 FROM a WHERE n % 11 = 0",
    "x3_common_ids": "SELECT a.id FROM a JOIN b ON a.id = b.id",
    "k10_graph_rows": "SELECT a.id, count(l.target) AS n_links, string_agg(l.target, ',' ORDER BY l.seq) AS targets, coalesce(max(d.concept_id), '') AS sources FROM a JOIN links l ON l.src_id = a.id LEFT JOIN derived d ON d.src_id = a.id GROUP BY a.id",
    "k13_diagnostic_lines": f"SELECT '[info] ' || concept || '.md: ' || message AS line FROM ({_V15})",
    "f1_concepts_of_type": "SELECT id FROM a WHERE type = 'Metric'",
    "f3_stale_on": "SELECT id FROM stale_now",
    "f4_broken_links": "SELECT src_id, raw FROM links WHERE NOT ok",
    "c1_link_kinds": "SELECT 'absolute' AS kind, count(*) AS n FROM links WHERE raw LIKE '/%' UNION ALL SELECT 'relative', count(*) FROM links WHERE raw NOT LIKE '/%' UNION ALL SELECT 'external', count(*) FROM a WHERE n % 11 = 0",
    "j1_resolve_links": "SELECT src_id, seq::BIGINT AS seq, target AS target_id, ok AS \"exists\", raw FROM links",
    "j2_derivations": "SELECT src_id, concept_id FROM derived",
    "j3_attributions": "SELECT id, 0::BIGINT AS ord, 's1' AS label, 1::BIGINT AS n_refs, 1::BIGINT AS n_defs, TRUE AS resolved FROM a WHERE n % 5 = 0 UNION ALL SELECT id, 1, 'zz', 1, 0, FALSE FROM a WHERE n % 5 = 0",
    "j15_computation_users": "SELECT c.id, count(DISTINCT l.src_id) AS n_users FROM a c LEFT JOIN links l ON l.target = c.id AND l.ok WHERE c.type = 'Attested Computation' GROUP BY c.id",
    "a1_backlinks": "SELECT target AS target_id, count(DISTINCT src_id) AS n, min(src_id) AS first_src FROM links WHERE ok GROUP BY target",
    "a2_derived_by": "SELECT concept_id, count(DISTINCT src_id) AS n FROM derived GROUP BY concept_id",
    "a3_tags": "SELECT tag, count(*) AS n, first(id ORDER BY 'd' || (n % 10), 'doc_' || n || '.md', pos) AS first_id FROM tagged GROUP BY tag",
    "a5_groups": "SELECT 'type' AS what, CASE WHEN type = '-' THEN '(none)' ELSE type END AS name, count(*) AS n FROM a GROUP BY type UNION ALL SELECT 'tier', ['unverified', 'machine-confirmed', 'human-reviewed'][tier + 1], count(*) FROM a GROUP BY tier UNION ALL SELECT 'status', status, count(*) FROM a GROUP BY status",
    "a6_summary": "SELECT 'concepts' AS measure, count(*) AS value FROM a UNION ALL SELECT 'with_sources', count(*) FROM a WHERE n % 5 = 0 UNION ALL SELECT 'computations', count(*) FROM a WHERE type = 'Attested Computation' UNION ALL SELECT 'stale', count(*) FROM stale_now UNION ALL SELECT 'index_files', 1 + count(DISTINCT n % 10) FROM listed UNION ALL SELECT 'log_files', 10 UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'broken_links', count(*) FROM links WHERE NOT ok UNION ALL SELECT 'derivation_edges', count(*) FROM derived UNION ALL SELECT 'tags', count(DISTINCT tag) FROM tagged",
    "a8_lint_codes": f"SELECT * FROM ({_union(_COUNTS)} UNION ALL SELECT 'L11', 'warning', count(*) FROM stale_now UNION ALL SELECT 'L10', 'warning', count(*) FROM ({_DEPRECATED}) UNION ALL SELECT 'L14', 'warning', count(*) FROM ({_SHARED}) UNION ALL SELECT 'L15', 'warning', count(*) FROM ({_LISTED_OR_LINKED}) UNION ALL SELECT 'L16', 'warning', count(DISTINCT n % 10) FROM listed) WHERE n > 0",
    "a8_validate_codes": f"""SELECT code, severity, sum(n)::BIGINT AS n FROM ({_union({
        "V2": ("error", "n % 53 = 0"), "V4": ("warning", "n % 29 = 0"), "V6": ("warning", "n % 31 = 0 AND n % 3 < 2"), "V7": ("warning", "status = 'experimental'"), "V13": ("info", "n % 7 = 0 AND n % 53 = 0"), "V14": ("warning", "n % 14 = 0 AND n % 53 <> 0")})}
        UNION ALL SELECT 'V3', 'warning', count(*) FROM a WHERE n % 43 = 0 UNION ALL SELECT 'V3', 'warning', count(*) FROM a WHERE n % 6 = 0 UNION ALL SELECT 'V3', 'warning', count(*) FROM a WHERE n % 9 = 0 AND n % 45 <> 0
        UNION ALL SELECT 'V8', 'warning', count(*) FROM a WHERE n % 37 = 0 OR n % 4 = 1 UNION ALL SELECT 'V8', 'info', count(*) FROM stale_now
        UNION ALL SELECT 'V11', 'warning', 2 * count(*) FROM a WHERE n % 5 = 0 UNION ALL SELECT 'V12', 'warning', count(*) FROM a WHERE n % 45 = 0 UNION ALL SELECT 'V12', 'warning', count(*) FROM a WHERE n % 11 = 0
        UNION ALL SELECT 'V15', 'info', count(*) FROM ({_V15}) UNION ALL SELECT 'V18', 'error', count(*) FROM ({_LOG_PROBLEMS}) UNION ALL SELECT 'V19', 'info', 1 UNION ALL SELECT 'V20', 'info', count(*) FROM links WHERE NOT ok) GROUP BY code, severity HAVING sum(n) > 0""",
    "v15_unresolved_paths": _V15,
    "v20_broken_link_findings": "SELECT src_id AS concept, 'link target does not resolve to a concept in the bundle: ' || raw AS message FROM links WHERE NOT ok",
    "l9_stale_verifications": "SELECT id AS concept, '[L9] latest verification (2026-05-' || (10 + n % 20) || 'T00:00:00Z) predates `generated.at` (2026-05-' || (10 + n % 17) || 'T08:00:00Z); the current content was never re-verified' AS message FROM a WHERE tier > 0 AND n % 9 <> 0 AND n % 20 <= n % 17",
    "l10_deprecated_links": f"SELECT src_id AS concept, '[L10] links to deprecated concept `' || target || '`' AS message FROM ({_DEPRECATED})",
    "l13_self_links": "SELECT id AS concept FROM a WHERE n % 97 = 0 OR (n * 7 + 3) % 1050 = n",
    "l14_duplicate_titles": "SELECT id AS concept, '[L14] `title` \"' || title || '\" is shared with another concept; titles should disambiguate' AS message FROM a WHERE title IN (SELECT title FROM a WHERE title <> '-' GROUP BY title HAVING count(*) > 1)",
    "l15_orphans": "SELECT id AS concept FROM a WHERE id NOT IN (SELECT target FROM links WHERE ok) AND id NOT IN (SELECT id FROM listed)",
    "l16_stale_indexes": "SELECT 'd' || k || '/index.md' AS path, '[L16] index.md is out of sync with its directory (' || CASE WHEN missing IS NULL THEN '' ELSE 'missing from index: ' || missing || '; ' END || 'listed but not on disk: d' || k || '/gone_' || k || ')' AS message FROM (SELECT DISTINCT n % 10 AS k FROM listed) LEFT JOIN (SELECT n % 10 AS j, string_agg(id, ', ' ORDER BY id) AS missing FROM a WHERE n % 3 = 0 GROUP BY n % 10) ON j = k",
    "w9_node_numbers": _NODES,
    "k5_index_entries": f"SELECT dir, type, title, link, description FROM (WITH files AS ({_FILES}) {_ENTRIES})",
    "k6_index_texts": f"""SELECT CASE WHEN dir = '' THEN 'index.md' ELSE dir || '/index.md' END AS rel_path, CASE WHEN dir = '' THEN '---' || chr(10) || 'okf_version: "0.1"' || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || string_agg(g, chr(10) || chr(10) ORDER BY type) || chr(10) AS content FROM
        (SELECT dir, type, '# ' || type || chr(10) || chr(10) || string_agg('* [' || title || '](' || link || ')' || CASE WHEN description = '' THEN '' ELSE ' - ' || description END, chr(10) ORDER BY lower(title), name) AS g FROM
        (SELECT dir, CASE WHEN type = '' THEN 'Other' ELSE type END AS type, title, link, description, name FROM (WITH files AS ({_FILES}) {_ENTRIES})) GROUP BY dir, type) GROUP BY dir""",
    "k8_graph_text": "SELECT src_id || '.md' AS path, 0::BIGINT AS part, 0::BIGINT AS seq, src_id AS line FROM (SELECT DISTINCT src_id FROM links) UNION ALL SELECT src_id || '.md', 1, seq, CASE WHEN ok THEN '  -> ' ELSE '  -x ' END || target FROM links UNION ALL SELECT src_id || '.md', 2, 0, '  ~> ' || concept_id || ' (source)' FROM derived",
    "k9_graph_mermaid": f"""SELECT 0::BIGINT AS part, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, 'flowchart LR' AS line UNION ALL SELECT 1, n, 0, 0, '  n' || n || '["' || id || '"]' FROM (SELECT * FROM nodes)
        UNION ALL SELECT 2, o.seq, 0, l.seq, '  n' || f.n || CASE WHEN ok THEN ' --> n' ELSE ' -.->|broken| n' END || t.n FROM links l JOIN nodes f ON f.id = l.src_id JOIN nodes t ON t.id = l.target JOIN ordered o ON o.id = l.src_id
        UNION ALL SELECT 2, o.seq, 1, 0, '  n' || f.n || ' -.->|source| n' || t.n FROM derived l JOIN nodes f ON f.id = l.src_id JOIN nodes t ON t.id = l.concept_id JOIN ordered o ON o.id = l.src_id""",
    "x1_added_and_removed": "SELECT 'removed' AS section, id FROM a WHERE n % 50 = 0",
    "j12_renames": "SELECT a.id AS \"old\", b.id AS \"new\" FROM a JOIN b ON a.n = b.n WHERE a.n % 50 = 1",
    "j11_changed_bodies": "SELECT id FROM a WHERE n % 50 = 2",
    "j13_frontmatter_diff": _FRONT_DIFF,
    "j14_trust_diff": f"SELECT id, 'status' AS kind, status AS \"old\", 'archived' AS \"new\" FROM ({_ARCHIVED})",
    "x4_link_diff": _LINK_DIFF,
    "stream_concept_types": "SELECT CASE WHEN type = '-' THEN '(none)' ELSE type END AS type, count(*) AS n FROM a GROUP BY type",
    "k1_serialized": f"SELECT id, sha256({_WRITTEN}) AS sha FROM (SELECT a.*, d.text FROM a JOIN documents d ON d.doc_id = a.n)",
    "a14_diff_size": f"SELECT section, count(*) AS changes FROM (SELECT 'removed' AS section, id AS i FROM a WHERE n % 50 = 0 UNION ALL SELECT 'renamed', id FROM a WHERE n % 50 = 1 UNION ALL SELECT 'content', id FROM a WHERE n % 50 = 2 UNION ALL SELECT 'frontmatter', id FROM a WHERE n % 50 IN (3, 4) UNION ALL SELECT 'trust', id FROM a WHERE n % 50 = 3 UNION ALL SELECT section, id FROM ({_LINK_DIFF})) GROUP BY section",
}


def oracle_sql() -> dict[str, str]:
    extra = {"k9_graph_mermaid": f", nodes AS ({_NODES}), ordered AS (SELECT id, row_number() OVER (ORDER BY 'd' || (n % 10), 'doc_' || n || '.md') AS seq FROM a)"}
    severity = "sum(n) FILTER (severity = '{}')"
    sums = ", ".join(f"coalesce({severity.format(s)}, 0)::BIGINT AS {s}s" for s in ("error", "warning", "info"))
    totals = f"SELECT {sums}, {severity.format('error')} IS NULL AS conformant FROM ({_ORACLES['a8_validate_codes']})"
    for name, same in (("k7_written_indexes", "k6_index_texts"), ("k4_written_documents", "k1_serialized"), ("j1_stream_links", "j1_resolve_links")):
        _ORACLES[name] = _ORACLES[same]
    return {"f5_totals": _PRELUDE + totals} | {k: _PRELUDE + extra.get(k, "") + "\n" + v for k, v in _ORACLES.items()} | {k: histories.PRELUDE + v for k, v in histories.ORACLES.items()} | _FORM_ORACLES | {"stream_late_sessions": _SESSIONS, "f13_segments": _SEGMENTS}
