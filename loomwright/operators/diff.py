"""What changed between two snapshots: ten sections, as one long table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import tier_name
from ..sources.parse import digest
from .ordering import cut_lineage, numbered_within

SECTIONS = ("added", "removed", "renamed", "content", "frontmatter", "trust", "added_links", "removed_links", "mended_links", "broken_links")
DIFF = ("bundle", "section", "segs", "id", "kind", "key", "old", "new")
_ROW = "struct<section:string,kind:string,key:string,old:string,new:string>"
_VERBS = {"added": "+", "removed": "-", "added_links": "+", "removed_links": "-", "mended_links": "+", "broken_links": "-"}


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """``bundle, rel_path`` of the files by which two snapshots can differ: those that are not once in each with the same content. Files
    that have a value that is no number stay too, since such a value always counts as changed."""
    odd = F.lower(F.decode("content", "iso-8859-1")).contains(".nan")
    side = lambda files, n: files.select("bundle", "rel_path", digest(), F.coalesce(odd, F.lit(False)).alias("odd"), F.lit(n).alias("side"))
    met = side(a, 1).unionByName(side(b, 2)).groupBy("bundle", "rel_path").agg(F.count("*").alias("n"), F.sum("side").alias("sides"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.bool_or("odd").alias("odd"))
    return met.where("n <> 2 or sides <> 3 or low <> high or odd").select("bundle", "rel_path")


def _row(section: str, kind: str = "", key: Column | None = None, old: Column | None = None, new: Column | None = None) -> Column:
    parts = {"section": F.lit(section), "kind": F.lit(kind), "key": key, "old": old, "new": new}
    return F.struct(*((c if c is not None else F.lit(None)).cast("string").alias(n) for n, c in parts.items()))


def _if(when: Column, row: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), row).otherwise(F.lit(None).cast(_ROW))


def _side(concepts: DataFrame, side: str) -> DataFrame:
    """What is compared of each concept: bodies and contents as digests."""
    digest = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.sha2(F.col(c), 256)))
    texts = F.filter("fm", lambda e: e["is_text"])
    first = F.filter(texts, lambda e, i: F.array_position(F.transform(texts, lambda x: x["key"]), e["key"]) == i + 1)
    own = {"segs": F.col("id_segs"), "body": digest("body"), "content": F.sha2(F.concat_ws("|", *map(digest, ("type", "title", "description", "body"))), 256), "fm": first, "tier": F.col("tier_rank"), "status": F.col("status")}
    return concepts.select("bundle", "id", *(c.alias(f"{side}_{n}") for n, c in own.items()))


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """The one join of both snapshots: a row for each concept of either."""
    return _side(a, "a").join(_side(b, "b"), ["bundle", "id"], "full_outer")


def renames(met: DataFrame) -> DataFrame:
    """``bundle, id, segs, old_id``: pairs of a removed and an added concept with equal content, in the order of their ids."""
    met = cut_lineage(met.where("a_segs is null or b_segs is null").select("bundle", "id", "a_segs", "a_content", "b_segs", "b_content"))
    side = lambda which, other: met.where(f"{other}_segs is null").select(F.struct("bundle", F.col(f"{which}_content").alias("content")).alias("same"), "id", F.col(f"{which}_segs").alias("segs"))
    # equal contents are numbered by ranges of their order, so very many of them are no single task's
    new, old = (numbered_within(side(*s), "same", "segs", name="n") for s in (("b", "a"), ("a", "b")))
    pairs = new.join(old.select(F.col("same").alias("other"), F.col("n").alias("m"), F.col("id").alias("old_id")), (F.col("same") == F.col("other")) & (F.col("n") == F.col("m")))
    return pairs.select("same.bundle", "id", "segs", "old_id")


def _frontmatter() -> Column:
    """Keys that came, went or changed; only text keys count and the first of repeated ones."""
    shown = lambda e: F.trim(F.regexp_replace(e["yaml"], r"\s+", " "))
    keys = lambda side: F.transform(f"{side}_fm", lambda e: e["key"])
    other = lambda e: F.element_at(F.filter("b_fm", lambda x: x["key"] == e["key"]), 1)
    came = F.filter("b_fm", lambda e: ~F.array_contains(keys("a"), e["key"]))
    went = F.filter("a_fm", lambda e: ~F.array_contains(keys("b"), e["key"]))
    stayed = F.filter("a_fm", lambda e: F.array_contains(keys("b"), e["key"]))
    changed = F.filter(stayed, lambda e: (e["canon"] != other(e)["canon"]) | e["nan"] | other(e)["nan"])
    return F.concat(
        F.transform(came, lambda e: _row("frontmatter", "added", e["key"])),
        F.transform(went, lambda e: _row("frontmatter", "removed", e["key"])),
        F.transform(changed, lambda e: _row("frontmatter", "changed", e["key"], shown(e), shown(other(e)))),
    )


def link_changes(a_links: DataFrame, b_links: DataFrame) -> DataFrame:
    """Edges that came and went, and targets that were mended and broken, by one grouping of both snapshots' links."""
    side = lambda d, n: d.select("bundle", F.col("src_segs").alias("segs"), F.col("src_id").alias("id"), "exists", F.when(F.col("exists"), F.col("target_id")).otherwise(F.col("raw")).alias("key"), F.lit(n).alias("side"))
    each = side(a_links, 1).unionByName(side(b_links, 2)).groupBy("bundle", "id", "exists", "key").agg(F.min("segs").alias("segs"), F.min("side").alias("low"), F.max("side").alias("high")).where("low = high")
    names = F.when(F.col("exists"), F.when(F.col("low") == 2, "added_links").otherwise("removed_links")).otherwise(F.when(F.col("low") == 1, "mended_links").otherwise("broken_links"))
    none = F.lit(None).cast("string")
    return each.select("bundle", names.alias("section"), "segs", "id", F.lit("link").alias("kind"), "key", none.alias("old"), none.alias("new"))


def changes(a: DataFrame, b: DataFrame, a_links: DataFrame | None, b_links: DataFrame | None, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """``bundle, section, segs, id, kind, key, old, new``: a and b are concepts of two snapshots of the same bundles, the
    links their resolved links (none where no section is about them). Only what ``sections`` asks for is planned. Concepts are joined once; what changed in
    one of them is an array expression over its row."""
    parts = []
    met = _met(a, b)
    if set(sections) & {"content", "frontmatter", "trust"}:
        rows = F.concat(
            F.array(_if(F.col("a_body") != F.col("b_body"), _row("content"))),
            _frontmatter() if "frontmatter" in sections else F.array().cast(f"array<{_ROW}>"),
            F.array(
                _if(F.col("a_tier") != F.col("b_tier"), _row("trust", "tier", F.lit("tier"), tier_name(F.col("a_tier")), tier_name(F.col("b_tier")))),
                _if(F.col("a_status") != F.col("b_status"), _row("trust", "status", F.lit("status"), F.col("a_status"), F.col("b_status"))),
            ),
        )
        both = met.where("a_segs is not null and b_segs is not null")
        parts.append(both.select("bundle", "id", F.col("a_segs").alias("segs"), F.explode(F.array_compact(rows)).alias("r")).select("bundle", "id", "segs", "r.*"))
    if set(sections) & {"added", "removed", "renamed"}:
        moved = renames(met)
        alone = met.where("a_segs is null or b_segs is null").select("bundle", "id", F.coalesce("a_segs", "b_segs").alias("segs"), F.when(F.col("a_segs").isNull(), "added").otherwise("removed").alias("section"))
        paired = moved.select("bundle", "id").unionByName(moved.select("bundle", F.col("old_id").alias("id")))
        none = F.lit(None).cast("string")
        parts.append(alone.join(paired, ["bundle", "id"], "left_anti").select("bundle", "id", "segs", "section", F.lit("").alias("kind"), none.alias("key"), none.alias("old"), none.alias("new")))
        parts.append(moved.select("bundle", "id", "segs", F.lit("renamed").alias("section"), F.lit("").alias("kind"), none.alias("key"), F.col("old_id").alias("old"), F.col("id").alias("new")))
    if any(s.endswith("links") for s in sections):
        parts.append(link_changes(a_links, b_links))
    return reduce(DataFrame.unionByName, [p.select(*DIFF) for p in parts]).where(F.col("section").isin(*sections))


def rendered(found: DataFrame) -> str:
    """The report as one text."""
    return "".join(f"{line}\n" for line in report_lines(found))


def report_lines(found: DataFrame) -> Iterator[str]:
    """The report, line by line: the driver holds a part of the sorted changes at a time."""
    totals = {r.section: r.changes for r in size(found).collect()}
    if not totals:
        yield "no changes"
    order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    kinds = F.array_position(F.array(*map(F.lit, ("added", "removed", "changed", "tier", "status"))), F.col("kind"))
    section = name = None
    texts = F.concat("kind", F.lit(" "), "old", F.lit(" -> "), "new")
    trust = found.where("section = 'trust'").groupBy("bundle", "section", "segs", "id").agg(F.array_join(F.sort_array(F.collect_list(F.struct(kinds.alias("k"), texts.alias("t"))))["t"], " ").alias("new"))
    found = found.where("section <> 'trust'").unionByName(trust, allowMissingColumns=True)
    for r in found.orderBy("bundle", order, "segs", kinds, F.split(F.coalesce("key", F.lit("")), "/")).toLocalIterator():
        grouped = r.section in ("frontmatter", "trust")
        if r.section != section:
            yield f"{r.section.replace('_', ' ')} ({totals[r.section]}):"
            section, name = r.section, None
        if grouped and r.id != name:
            if section == "frontmatter":
                yield f"  {r.id}:"
            name = r.id
        if section == "frontmatter":
            yield f"    + {r.key}" if r.kind == "added" else f"    - {r.key}" if r.kind == "removed" else f"    ~ {r.key}: {r.old} -> {r.new}"
        elif section == "trust":
            yield f"  {r.id}: {r.new}"
        elif section == "renamed":
            yield f"  ~ {r.old} -> {r.new}"
        elif section == "content":
            yield f"  ~ {r.id} (body)"
        elif section.endswith("links"):
            yield f"  {_VERBS[section]} {r.id} -> {r.key}"
        else:
            yield f"  {_VERBS[section]} {r.id}"


def size(found: DataFrame) -> DataFrame:
    """``section, changes``: as many as a report lists; frontmatter and trust count concepts."""
    unit = F.when(F.col("section").isin("frontmatter", "trust"), F.col("id")).otherwise(F.concat_ws("\x1f", "id", F.coalesce("key", "old", F.lit(""))))
    return found.groupBy("section").agg(F.countDistinct(unit).alias("changes"))
