"""Conformance rules. Rules of one concept are one array expression and one explode; the rest are joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import STEP, blank, field_paths, portable, quoted, resource_kind, trimmed, type_label
from . import logs
from .concepts import CONTRACT_TYPE, KNOWN_STATUS, entries, filled, kind, node, path_fields, text

# The wording of messages, here and in the health rules, is a fixed value: users and tests match on it.
FORMAT_VERSION, READABLE_VERSIONS = "0.2", ("0.1", "0.2")
REPORT = ("bundle", "phase", "path_segs", "rule", "item", "sub", "severity", "code", "path", "concept", "message")
_FINDING = "struct<rule:int,item:int,sub:int,severity:string,code:string,message:string>"


def text_of(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def finding(when: Column, rule: int, severity: str, code: str, *message: str | Column, item: Column | int = 0, sub: int = 0) -> Column:
    """The finding if ``when`` holds (null counts as no), else null."""
    number = item if isinstance(item, Column) else F.lit(item)
    made = F.struct(F.lit(rule).alias("rule"), number.cast("int").alias("item"), F.lit(sub).alias("sub"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), text_of(*message).alias("message"))
    return F.when(F.coalesce(when, F.lit(False)), made).otherwise(F.lit(None).cast(_FINDING))


def each(paths: Column, make) -> Column:
    """Findings of every item of a list of paths: ``make(path, index)`` gives some."""
    return F.flatten(F.transform(paths, lambda p, i: F.array(*make(p, i))))


def exploded(concepts: DataFrame, phase: int, *groups: Column) -> DataFrame:
    """One row for each finding in the arrays."""
    rows = concepts.select("bundle", "path_segs", F.col("rel_path").alias("path"), F.col("id").alias("concept"), F.explode(F.array_compact(F.concat(*groups))).alias("f"))
    return rows.select("bundle", F.lit(phase).alias("phase"), "path_segs", "f.rule", "f.item", "f.sub", "f.severity", "f.code", "path", "concept", "f.message")


def _n(i: Column) -> Column:
    return i.cast("string")


def _bad_shape(key: str) -> Column:
    return filled(key) & ~kind(key).isin("list", "map")


def _index(path: Column) -> Column:
    """Number of a list item in its path; 0 for a bare mapping."""
    return F.when(path.contains(STEP), F.element_at(F.split(path, STEP), -1)).otherwise("0")


def concept_rules(concepts: DataFrame, today: str | None) -> DataFrame:
    """V2 to V14 of every concept."""
    required = F.array(
        finding(F.lit(True) & (~filled("type") | text("type").isNull()), 2, "error", "V2", F.when(node("type").isNotNull() & text("type").isNull(), "`type` must be a non-empty scalar (§4.1)").otherwise("missing required frontmatter field `type` (§4.1)")),
        *(finding(~filled(f) & (~filled("timestamp") if f == "generated" else F.lit(True)), 3, "warning", "V3", f"missing recommended frontmatter field `{f}` ({'§5.2' if f == 'generated' else '§4.1'})", item=i) for i, f in enumerate(("title", "description", "generated"))),
        finding(filled("tags") & (kind("tags") != "list"), 4, "warning", "V4", "`tags` should be a list of short strings, found ", type_label(kind("tags")), "; no tags are read from it (§4.1)"),
        finding(filled("generated") & F.col("generated").isNull(), 5, "warning", "V5", "`generated` should be a `{ by, at }` mapping, found ", type_label(kind("generated")), " (§5.2)"),
        finding(filled("generated") & F.col("generated").isNotNull() & F.col("generated.by").isNull(), 5, "warning", "V5", "`generated.by` is required within `generated` (§5.2)", sub=1),
        finding(filled("generated") & F.col("generated.at").isNotNull() & ~F.coalesce(F.col("generated.moment.has_time"), F.lit(False)), 5, "warning", "V5", "`generated.at` is not an ISO-8601 datetime: ", quoted(F.col("generated.at")), " (§5.2)", sub=2),
        finding(_bad_shape("verified"), 6, "warning", "V6", "`verified` should be a list of `{ by, at }` events (a bare mapping is read as a one-element list), found ", type_label(kind("verified")), " (§5.2)"),
        finding(filled("verified") & ~_bad_shape("verified") & (F.size("verified") == 0), 6, "warning", "V6", "`verified` contains no `{ by, at }` events (§5.2)", sub=1),
    )

    def event(p: Column, i: Column) -> list[Column]:
        is_map, at = kind(p) == "map", text(p, "at")
        return [
            finding(filled("verified") & ~is_map, 6, "warning", "V6", "`verified[", _n(i), "]` should be a mapping with `by` and `at`, found ", type_label(kind(p)), " (§5.2)", item=i + 1),
            finding(filled("verified") & is_map & F.coalesce(blank(text(p, "by")), F.lit(True)), 6, "warning", "V6", "`verified[", _n(i), "].by` is missing (§5.2)", item=i + 1, sub=1),
            finding(filled("verified") & is_map & at.isNull(), 6, "warning", "V6", "`verified[", _n(i), "].at` is missing (§5.2)", item=i + 1, sub=2),
            finding(filled("verified") & is_map & at.isNotNull() & ~F.coalesce(node(p, "at")["moment"]["has_time"], F.lit(False)), 6, "warning", "V6", "`verified[", _n(i), "].at` is not an ISO-8601 datetime: ", quoted(F.coalesce(at, F.lit(""))), " (§5.2)", item=i + 1, sub=3),
        ]

    day = F.lit(today).cast("date") if today else F.lit(None).cast("date")
    life = F.array(
        finding(~F.col("status").isin(*KNOWN_STATUS), 7, "warning", "V7", "unknown `status` value ", quoted(F.col("status")), f"; §5.4 defines {', '.join(KNOWN_STATUS)} (consumers must still accept it)"),
        finding(F.col("stale_after").isNotNull() & F.col("stale_after.date").isNull(), 8, "warning", "V8", "`stale_after` is not an absolute `YYYY-MM-DD` date: ", quoted(F.coalesce("stale_after.raw", F.lit(""))), " (§5.5)"),
        finding(day >= F.col("stale_after.date"), 8, "info", "V8", "stale since ", F.coalesce(F.date_format("stale_after.date", "yyyy-MM-dd"), F.lit("")), " (§5.5)", sub=1),
    )
    has_sources = filled("sources") & ~_bad_shape("sources")
    frame = F.array(
        finding(~filled("sources") & node("usage_window").isNotNull(), 9, "warning", "V9", "`usage_window` is present without `sources` to frame (§5.1)"),
        finding(_bad_shape("sources"), 9, "warning", "V9", "`sources` should be a list of entries, found ", type_label(kind("sources")), " (§5.1)"),
        *(finding(has_sources & F.col(f"usage_window.{e}").isNotNull() & F.col(f"usage_window.{e}.date").isNull(), 9, "warning", "V9", f"`usage_window.{e}` is not a `YYYY-MM-DD` date: ", quoted(F.coalesce(f"usage_window.{e}.raw", F.lit(""))), " (§5.1)", item=1, sub=i) for i, e in enumerate(("from", "to"))),
    )
    items = entries("sources")
    not_entries = each(items, lambda p, i: [finding(has_sources & (kind(p) != "map"), 10, "warning", "V10", "`sources[", _n(i), "]` should be a mapping entry, found ", type_label(kind(p)), " (§5.1)", item=i)])
    maps = F.filter(items, lambda p: kind(p) == "map")

    def source(p: Column, i: Column) -> list[Column]:
        own_id, modified = text(p, "id"), text(p, "last_modified")
        earlier = F.exists(F.slice(maps, 1, F.greatest(i, F.lit(0))), lambda q: text(q, "id") == own_id)
        framed = (kind(p, "usage_window") == "map") | F.col("usage_window").isNotNull()
        return [
            finding(resource_kind(text(p, "resource")) == "missing", 11, "warning", "V10", "`sources[", _index(p), "].resource` is required within an entry (§5.1)", item=i),
            finding(earlier, 11, "warning", "V10", "duplicate `sources[].id` ", quoted(F.coalesce(own_id, F.lit(""))), "; ids are the join key for attribution (§5.1)", item=i, sub=1),
            finding(modified.isNotNull() & node(p, "last_modified")["day"].isNull(), 11, "warning", "V10", "`sources[", _index(p), "].last_modified` is not a `YYYY-MM-DD` date: ", quoted(F.coalesce(modified, F.lit(""))), " (§5.1)", item=i, sub=2),
            finding((kind(p, "usage_count") == "int") & ~F.coalesce(framed, F.lit(False)), 11, "warning", "V10", "`sources[", _index(p), "].usage_count` has no `usage_window` to frame it (§5.1)", item=i, sub=3),
        ]

    of_sources = F.when(has_sources, each(maps, source)).otherwise(F.array().cast(f"array<{_FINDING}>"))
    counts = each(items, lambda p, i: [finding(has_sources & (kind("sources") == "list") & (kind(p, "usage_count") != "int"), 12, "warning", "V10", "`sources[", _n(i), "].usage_count` should be an integer, found ", type_label(kind(p, "usage_count")), " (§5.1)", item=i)])
    labels = F.array_distinct(F.concat(F.col("refs.label"), F.col("defs.label")))
    notes = F.flatten(F.transform(labels, lambda label, i: F.array(
        finding((F.size("sources") > 0) & ~F.exists("sources", lambda s: F.coalesce(s["id"] == label, F.lit(False))), 13, "warning", "V11", "footnote [^", label, "] matches no `sources[].id`; the label is the join key for attribution (§5.1)", item=i),
        finding(F.exists("refs", lambda r: r["label"] == label) & ~F.exists("defs", lambda d: d["label"] == label), 13, "warning", "V11", "footnote [^", label, "] is cited but never defined (§5.1)", item=i, sub=1),
    )))
    keys = ("runtime", "parameters", "computation", "executor", "attester")
    present = F.array_compact(F.array(*(F.when(filled(k), F.lit(k)) for k in keys)))
    code, own_path = F.col("is_contract"), F.coalesce(~blank(F.col("computation")), F.lit(False))
    block = F.col("inline").isNotNull()
    contract = F.array(
        finding(filled("timestamp") & ~filled("generated"), 14, "warning", "V12", "`timestamp` is superseded by `generated: { by, at }` (§13.1)"),
        finding(filled("timestamp") & filled("generated"), 14, "warning", "V12", "`timestamp` is redundant alongside `generated` and should be removed (§13.1)"),
        finding(F.size("citations") > 0, 14, "warning", "V12", "the body `# Citations` list is superseded by the `sources` frontmatter field (§13.1)", sub=1),
        finding(~code & (F.size(present) > 0), 15, "info", "V13", "carries computation field(s) `", F.array_join(present, "`, `"), f"` but `type` is not `{CONTRACT_TYPE}`; a sanctioned computation is its own concept (§10.1)"),
        finding(code & F.coalesce(blank(F.col("runtime")), F.lit(True)), 16, "warning", "V14", "`runtime` is required on an `Attested Computation`; it defines what `parameters` mean (§10.2)"),
        finding(code & ~own_path & ~block, 16, "warning", "V14", "no computation: set `computation` to a path or add a `# Computation` block to the body (§10.3)", sub=1),
        finding(code & own_path & block, 16, "warning", "V14", "`computation` names a file and the body also has a `# Computation` block; §10.3 asks for one or the other", sub=1),
    )
    parameters = F.flatten(F.transform("parameters", lambda p, i: F.array(
        finding(code & p["name"].isNull(), 17, "warning", "V14", "`parameters[", _n(i), "].name` is missing (§10.2)", item=i),
        finding(code & p["type"].isNull(), 17, "warning", "V14", "`parameters[", _n(i), "].type` is missing (§10.2)", item=i, sub=1),
    )))
    runs = F.array(
        finding(code & F.col("executor").isNull(), 18, "warning", "V14", "missing `executor`: nothing says how to run the computation (§10.2)"),
        finding(code & F.col("executor").isNotNull() & F.col("executor.resource").isNull(), 18, "warning", "V14", "`executor.resource` is missing; it names the run instructions or code (§10.2)", sub=1),
        finding(code & F.col("executor").isNotNull() & (F.size("executor.receipt") == 0), 18, "warning", "V14", "`executor.receipt` is empty; it declares the evidence the attester inspects (§10.2)", sub=2),
        finding(code & F.col("attester").isNull(), 19, "warning", "V14", "missing `attester`: nothing can check a run's receipt (§10.2)"),
        finding(code & F.col("attester").isNotNull() & F.col("attester.resource").isNull(), 19, "warning", "V14", "`attester.resource` is missing; it names the deterministic check (§10.2)"),
    )
    return exploded(concepts, 2, required, each(entries("verified"), event), life, frame, not_entries, of_sources, counts, notes, contract, parameters, runs)


def unresolved_paths(concepts: DataFrame, files: DataFrame) -> DataFrame:
    """V15: path fields none of whose readings is a file of the bundle."""
    fields = concepts.select("bundle", "path_segs", F.col("rel_path").alias("path"), "id", "id_segs", F.posexplode(path_fields()).alias("item", "f"))
    target = trimmed(F.col("f.raw"))
    fields = fields.where((F.col("f.field") != "resource") | target.rlike(r"^(/|\./|\.\./)")).withColumn("ways", field_paths(target, F.col("id_segs"))).where(F.size("ways") > 0)
    known = files.select(F.col("bundle").alias("fb"), F.col("rel_path").alias("fp")).distinct()
    hits = fields.select("bundle", "id", "item", F.explode("ways").alias("way")).join(known, (F.col("bundle") == F.col("fb")) & (F.col("way") == F.col("fp")), "left_semi").select("bundle", "id", "item").distinct()
    lost = fields.join(hits, ["bundle", "id", "item"], "left_anti")
    return lost.select("bundle", F.lit(2).alias("phase"), "path_segs", F.lit(20).alias("rule"), "item", F.lit(0).alias("sub"), F.lit("info").alias("severity"), F.lit("V15").alias("code"), "path", F.col("id").alias("concept"), text_of("`", F.col("f.field"), "` does not resolve to a file in the bundle: ", F.col("f.raw"), " (§6.2)").alias("message"))


def odd_segments(concepts: DataFrame) -> DataFrame:
    """V16: each non-portable step once, where it comes first."""
    parts = concepts.select("bundle", "path_segs", F.col("rel_path").alias("path"), F.col("id").alias("concept"), F.posexplode("id_segs").alias("item", "segment")).where(~portable(F.col("segment")))
    first = parts.groupBy("bundle", "segment").agg(F.min(F.struct("path_segs", "item", "path", "concept")).alias("f"))
    message = text_of("concept-id segment ", quoted(F.col("segment")), " is outside the conventional `[A-Za-z0-9_][A-Za-z0-9_.-]*` set; the bundle is still conformant, but such a name needs `<...>` or percent-encoding to link portably and is not guaranteed to survive every filesystem unchanged (§2)")
    return first.select("bundle", F.lit(3).alias("phase"), "f.path_segs", F.lit(0).alias("rule"), "f.item", F.lit(0).alias("sub"), F.lit("warning").alias("severity"), F.lit("V16").alias("code"), "f.path", "f.concept", message.alias("message"))


def _file_report(rows: DataFrame, phase: int, code: str, message: Column, item: Column | None = None, rule: Column | None = None) -> DataFrame:
    return rows.select("bundle", F.lit(phase).alias("phase"), "path_segs", (rule if rule is not None else F.lit(0)).alias("rule"), (item if item is not None else F.lit(0)).cast("int").alias("item"), F.lit(0).alias("sub"), F.lit("error").alias("severity"), F.lit(code).alias("code"), F.col("rel_path").alias("path"), F.lit(None).cast("string").alias("concept"), message.alias("message"))


def reserved_files(rows: DataFrame) -> DataFrame:
    """V17 and V18: index files and logs."""
    indexes, log_files = rows.where("role = 'index'"), rows.where("role = 'log'")
    is_root = F.size("path_segs") == 1
    only_version = F.forall("fm", lambda e: ~e["is_text"] | (e["key"] == "okf_version"))
    message = (
        F.when(~F.col("utf8_ok"), text_of("unreadable reserved index.md: ", F.col("error"), " (§8)"))
        .when(F.col("error").isNotNull(), text_of("unparseable reserved index.md: ", F.col("error"), " (§8)"))
        .when(~F.col("has_frontmatter"), None)
        .when(is_root & ~only_version, "root index.md frontmatter should declare only `okf_version` (§12)")
        .when(~is_root, "index.md should not contain frontmatter (§8)")
    )
    found = _file_report(indexes.withColumn("m", message).where("m is not null"), 4, "V17", F.col("m"))
    unread = _file_report(log_files.where("not utf8_ok"), 5, "V18", text_of("unreadable reserved log.md: ", F.col("error"), " (§9)"))
    bad = logs.problems(log_files)
    return found.unionByName(unread).unionByName(_file_report(bad, 5, "V18", F.when(F.col("phase") < 4, text_of(F.col("message"), " (§9)")).otherwise(text_of(F.col("message"), " (§9)")), F.col("item"), F.col("phase")))


def declared_version(rows: DataFrame) -> DataFrame:
    """``bundle, version``: what each root index declares, where that is a text."""
    v = F.try_element_at("node", F.lit("okf_version"))
    return rows.where("role = 'index' and size(path_segs) = 1 and error is null").where(v["kind"] == "string").select("bundle", v["text"].alias("version"))


def version_rule(rows: DataFrame) -> DataFrame:
    """V19."""
    v = trimmed(F.col("version"))
    message = F.when(v.isin(*READABLE_VERSIONS), text_of("bundle targets format v", v, f"; read as v{FORMAT_VERSION} under the §13.1 fallbacks")).otherwise(text_of("bundle declares an unrecognized `okf_version: ", v, f"`; consuming it best-effort as v{FORMAT_VERSION} (§12)"))
    odd = declared_version(rows).where(v != FORMAT_VERSION)
    return odd.select("bundle", F.lit(6).alias("phase"), F.array(F.lit("index.md")).alias("path_segs"), F.lit(0).alias("rule"), F.lit(0).alias("item"), F.lit(0).alias("sub"), F.lit("info").alias("severity"), F.lit("V19").alias("code"), F.lit("index.md").alias("path"), F.lit(None).cast("string").alias("concept"), message.alias("message"))


def broken(resolved: DataFrame) -> DataFrame:
    """V20."""
    lost = resolved.where("not exists")
    return lost.select("bundle", F.lit(7).alias("phase"), F.col("src_path").alias("path_segs"), F.lit(0).alias("rule"), F.col("seq").alias("item"), F.lit(0).alias("sub"), F.lit("info").alias("severity"), F.lit("V20").alias("code"), F.lit(None).cast("string").alias("path"), F.col("src_id").alias("concept"), text_of("link target does not resolve to a concept in the bundle: ", F.col("raw")).alias("message"))


def unparsed(rows: DataFrame) -> DataFrame:
    """V1."""
    return _file_report(rows.where("role = 'concept' and error is not null"), 1, "V1", text_of("unparseable concept document: ", F.col("error")))


def report(rows: DataFrame, concepts: DataFrame, files: DataFrame, resolved: DataFrame, today: str | None = None) -> DataFrame:
    """Every finding; ``in_order`` sorts them as a reader expects."""
    parts = [unparsed(rows), concept_rules(concepts, today), unresolved_paths(concepts, files), odd_segments(concepts), reserved_files(rows), version_rule(rows), broken(resolved)]
    return reduce(DataFrame.unionByName, [p.select(*REPORT) for p in parts])


def in_order(found: DataFrame) -> DataFrame:
    return found.orderBy("bundle", "phase", "path_segs", "rule", "item", "sub")


def totals(found: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """``bundle, errors, warnings, infos, conformant``. With ``bundles`` (``bundle``) each of those has a row, one without findings
    too, which is conformant; else only bundles with findings have one."""
    count = lambda s: F.count_if(F.col("severity") == s)
    rows = found.select("bundle", "severity")
    if bundles is not None:
        rows = rows.unionByName(bundles.select("bundle", F.lit("none").alias("severity")).distinct())
    return rows.groupBy("bundle").agg(count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"), F.bool_and(F.col("severity") != "error").alias("conformant"))
