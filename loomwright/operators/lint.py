"""Health rules L1 to L16."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import names_concept, parent, quoted, trimmed
from . import graph
from .concepts import node
from .validate import REPORT, exploded, finding, text_of


def _rule(when: Column, number: int, severity: str, *message: str | Column) -> Column:
    return finding(when, number, severity, f"L{number}", f"[L{number}] ", *message)


def concept_rules(concepts: DataFrame, today: str | None) -> DataFrame:
    """The rules that one concept decides alone."""
    day = F.lit(today).cast("date") if today else F.lit(None).cast("date")
    empty = trimmed(F.col("body")) == ""
    latest, made = F.col("latest_verification.moment"), F.col("generated.moment")
    shown = F.coalesce(F.date_format("stale_after.effective", "yyyy-MM-dd"), F.lit(""))
    return exploded(
        concepts, 1,
        F.array(
            _rule(F.col("title").isNull(), 1, "warning", "missing `title`; consumers fall back to the filename, but a human-readable title is recommended"),
            _rule(F.col("description").isNull(), 2, "warning", "missing `description`; a one-line summary is recommended and what `index.md` listings display"),
            _rule(node("generated").isNull() & F.col("timestamp").isNull(), 3, "warning", "missing `generated`; a continuously-authored corpus should record who produced the content and when"),
            _rule(node("verified").isNull(), 4, "info", "no `verified` events; trust tier is `unverified`"),
            _rule(F.col("timestamp").isNotNull(), 5, "warning", "`timestamp` is a v0.1 key superseded by `generated: { by, at }`"),
            _rule(F.size("citations") > 0, 6, "warning", "body `# Citations` list is superseded by `sources` + footnote attribution"),
            _rule(empty, 7, "warning", "body is empty; a concept should carry at least one line of prose or code"),
            _rule(~empty & ~F.col("body").rlike(r"(?m)(?:\A|(?<=\n))[^\S\n]*# "), 8, "warning", "body has no top-level `#` heading; documents conventionally open with one"),
            _rule(latest.isNotNull() & made.isNotNull() & (F.struct(latest["second"], latest["nano"]) < F.struct(made["second"], made["nano"])), 9, "warning", "latest verification (", F.coalesce(latest["text"], F.lit("")), ") predates `generated.at` (", F.coalesce(made["text"], F.lit("")), "); the current content was never re-verified"),
            _rule(day >= F.col("stale_after.effective"), 11, "warning", "stale since ", shown, " (`stale_after` passed)"),
            _rule(F.col("status") == "draft", 12, "info", "`status: draft`; a draft concept is not ready for production consumption"),
        ),
    )


def _report(rows: DataFrame, phase: int, number: int, severity: str, message: Column, item: Column | None = None) -> DataFrame:
    """Findings from rows of ``bundle, path_segs, path, concept``."""
    return rows.select("bundle", F.lit(phase).alias("phase"), "path_segs", F.lit(number).alias("rule"), (item if item is not None else F.lit(0)).alias("item"), F.lit(0).alias("sub"), F.lit(severity).alias("severity"), F.lit(f"L{number}").alias("code"), "path", "concept", message.alias("message"))


def _names(concepts: DataFrame) -> DataFrame:
    return concepts.select("bundle", "path_segs", F.col("rel_path").alias("path"), F.col("id").alias("concept"))


def deprecated_links(concepts: DataFrame, resolved: DataFrame) -> DataFrame:
    """L10: each deprecated concept once for each concept that links to it, at its first link."""
    old = concepts.where("status = 'deprecated'").select(F.col("bundle").alias("ob"), F.col("id").alias("oi"))
    met = resolved.where("exists").join(old, (F.col("bundle") == F.col("ob")) & (F.col("target_id") == F.col("oi")))
    met = met.groupBy("bundle", F.col("src_id").alias("concept"), "target_id").agg(F.min("seq").alias("seq"))
    return _report(met.join(_names(concepts), ["bundle", "concept"]), 1, 10, "warning", text_of("[L10] links to deprecated concept `", F.col("target_id"), "`"), F.col("seq"))


def self_links(concepts: DataFrame, resolved: DataFrame) -> DataFrame:
    """L13: at most one a concept."""
    own = resolved.where("exists and src_id = target_id").select("bundle", F.col("src_id").alias("concept")).distinct()
    return _report(_names(concepts).join(own, ["bundle", "concept"], "left_semi"), 1, 13, "info", F.lit("[L13] self-link; a concept that links to itself usually signals a stray reference"))


def shared_titles(concepts: DataFrame) -> DataFrame:
    """L14: titles that more than one concept has. Counts are small rows, so a title of a third of all concepts is no hot group."""
    twice = concepts.where("title is not null").groupBy("bundle", "title").count().where("count > 1").drop("count")
    rows = concepts.select("bundle", "title", "path_segs", F.col("rel_path").alias("path"), F.col("id").alias("concept")).join(twice, ["bundle", "title"], "left_semi")
    return _report(rows, 1, 14, "warning", text_of("[L14] `title` ", quoted(F.col("title")), " is shared with another concept; titles should disambiguate"))


def orphans(concepts: DataFrame, resolved: DataFrame, listings: DataFrame) -> DataFrame:
    """L15: neither linked (by itself or others) nor listed in an index."""
    linked = resolved.where("exists").select("bundle", F.col("target_id").alias("concept"))
    named = listings.where(names_concept(F.col("raw"))).select("bundle", F.col("target_id").alias("concept"))
    rows = _names(concepts).join(linked.unionByName(named).distinct(), ["bundle", "concept"], "left_anti")
    return _report(rows, 2, 15, "warning", F.lit("[L15] orphan concept: no other concept links to it and no `index.md` lists it"))


def stale_indexes(concepts: DataFrame, indexes: DataFrame, listings: DataFrame) -> DataFrame:
    """L16: what an index should list and does not, and what it lists that is not there. An index that cannot be read
    lists nothing."""
    folders = indexes.select("bundle", "rel_path", "path_segs", F.slice("path_segs", 1, F.size("path_segs") - 1).alias("dir_segs"))
    here = concepts.select("bundle", parent(F.col("id_segs")).alias("dir_segs"), F.col("id_segs").alias("target_segs"))
    actual = folders.join(here, ["bundle", "dir_segs"]).select("bundle", "rel_path", "path_segs", "target_segs")
    listed = listings.where(names_concept(F.col("raw")) & (parent(F.col("target_segs")) == F.col("dir_segs"))).select("bundle", "rel_path", "path_segs", "target_segs").distinct()
    sides = actual.withColumn("a", F.lit(1)).withColumn("l", F.lit(0)).unionByName(listed.withColumn("a", F.lit(0)).withColumn("l", F.lit(1)))
    sides = sides.groupBy("bundle", "rel_path", "path_segs", "target_segs").agg(F.max("a").alias("a"), F.max("l").alias("l")).where("a <> l")
    names = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.col("target_segs")))), lambda s: F.array_join(s, "/")), ", ")
    odd = sides.groupBy("bundle", "rel_path", "path_segs").agg(names(F.col("a") == 1).alias("missing"), names(F.col("l") == 1).alias("extra"))
    parts = F.array_compact(F.array(F.when(F.col("missing") != "", text_of("missing from index: ", F.col("missing"))), F.when(F.col("extra") != "", text_of("listed but not on disk: ", F.col("extra")))))
    rows = odd.withColumn("path", F.col("rel_path")).withColumn("concept", F.lit(None).cast("string"))
    return _report(rows, 3, 16, "warning", text_of("[L16] index.md is out of sync with its directory (", F.array_join(parts, "; "), ")"))


def report(rows: DataFrame, concepts: DataFrame, resolved: Callable[[], DataFrame], today: str | None = None, codes: tuple[str, ...] = ()) -> DataFrame:
    """All findings, or those of ``codes``; links are resolved only where a rule that is asked for is about them."""
    indexes = rows.where("role = 'index'")
    asked = lambda *own: not codes or bool(set(own) & set(codes))
    parts = [concept_rules(concepts, today)]
    if asked("L10"):
        parts.append(deprecated_links(concepts, resolved()))
    if asked("L13"):
        parts.append(self_links(concepts, resolved()))
    if asked("L14"):
        parts.append(shared_titles(concepts))
    if asked("L15"):
        parts.append(orphans(concepts, resolved(), graph.index_listings(indexes)))
    if asked("L16"):
        parts.append(stale_indexes(concepts, indexes, graph.index_listings(indexes)))
    found = reduce(DataFrame.unionByName, [p.select(*REPORT) for p in parts])
    return found.where(F.col("code").isin(*codes)) if codes else found
