"""Typed columns of concepts, taken from parsed frontmatter by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import STEP, actor_kind, blank, tier_name, trimmed

CONTRACT_TYPE = "Attested Computation"
KNOWN_STATUS = ("draft", "stable", "deprecated")
# The keys that frontmatter gives a meaning to, and the order in which they are written (fixed values).
KNOWN_KEYS = (
    "type", "title", "description", "resource", "tags", "sources", "usage_window", "generated", "verified", "status",
    "stale_after", "runtime", "parameters", "computation", "executor", "attester", "timestamp",
)
PREFERRED_KEYS = ("type", "resource", "title", "description", "tags", "status", "generated", "verified", "stale_after", "sources", "usage_window")


def node(*steps: str | Column) -> Column:
    """The value at a path into the frontmatter; null where there is none."""
    path = F.lit(STEP.join(steps)) if all(isinstance(s, str) for s in steps) else F.concat_ws(STEP, *(F.lit(s) if isinstance(s, str) else s for s in steps))
    return F.try_element_at(F.col("node"), path)


def text(*steps: str | Column) -> Column:
    return node(*steps)["text"]


def kind(*steps: str | Column) -> Column:
    return node(*steps)["kind"]


def date(*steps: str | Column) -> Column:
    """The value's date, if its text is exactly one."""
    return F.date_from_unix_date(node(*steps)["day"])


def filled(*steps: str | Column) -> Column:
    """Whether there is a value that is not empty."""
    return F.coalesce(~node(*steps)["empty"], F.lit(False))


def entries(key: str) -> Column:
    """Paths of the items of a list; a bare mapping is a list of one; anything else is empty."""
    n = node(key)["n"]
    many = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.lit(key + STEP), i.cast("string"))))
    return F.when(kind(key) == "list", F.coalesce(many, F.array().cast("array<string>"))).when(kind(key) == "map", F.array(F.lit(key))).otherwise(F.array().cast("array<string>"))


def _window(*steps: str | Column) -> Column:
    part = lambda k: F.struct(text(*steps, k).alias("raw"), date(*steps, k).alias("date"))
    return F.when(kind(*steps) == "map", F.struct(F.when(text(*steps, "from").isNotNull(), part("from")).alias("from"), F.when(text(*steps, "to").isNotNull(), part("to")).alias("to")))


def _event(path: Column | str) -> Column:
    by, at = text(path, "by"), text(path, "at")
    moment = node(path, "at")["moment"]
    return F.struct(
        by.alias("by"),
        actor_kind(by).alias("by_kind"),
        at.alias("at"),
        moment.alias("moment"),
        F.coalesce(~blank(by) & moment["has_time"], F.lit(False)).alias("valid"),
    )


def _source(path: Column) -> Column:
    modified = text(path, "last_modified")
    return F.struct(
        text(path, "id").alias("id"),
        text(path, "resource").alias("resource"),
        text(path, "title").alias("title"),
        text(path, "author").alias("author"),
        F.when(kind(path, "usage_count") == "int", text(path, "usage_count").cast("long")).alias("usage_count"),
        F.when(modified.isNotNull(), F.struct(modified.alias("raw"), date(path, "last_modified").alias("date"))).alias("last_modified"),
        _window(path, "usage_window").alias("usage_window"),
    )


def typed(rows: DataFrame) -> DataFrame:
    """Add the typed columns to parsed rows without an error."""
    mappings = lambda key: F.filter(entries(key), lambda p: F.coalesce(kind(p) == "map", F.lit(False)))
    stale = text("stale_after")
    receipt = node("executor", "receipt")
    receipts = F.when(receipt["kind"] == "list", F.filter(F.transform(F.sequence(F.lit(0), F.greatest(receipt["n"] - 1, F.lit(0))), lambda i: text("executor", "receipt", i.cast("string"))), lambda t: t.isNotNull()))
    tag_list = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(node("tags")["n"] - 1, F.lit(0))), lambda i: text("tags", i.cast("string"))), lambda t: t.isNotNull())
    out = rows.select(
        "*",
        *(text(k).alias(k) for k in ("type", "title", "description", "resource", "runtime", "computation", "timestamp")),
        F.when(kind("tags") == "list", tag_list).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.transform(mappings("sources"), _source).alias("sources"),
        _window("usage_window").alias("usage_window"),
        F.when(kind("generated") == "map", _event("generated")).alias("generated"),
        F.transform(mappings("verified"), _event).alias("verified"),
        F.when(F.coalesce(trimmed(text("status")), F.lit("")) == "", "stable").otherwise(trimmed(text("status"))).alias("status"),
        F.when(stale.isNotNull(), F.struct(stale.alias("raw"), date("stale_after").alias("date"), F.date_from_unix_date(F.coalesce(node("stale_after")["day"], node("stale_after")["moment"]["day"])).alias("effective"))).alias("stale_after"),
        F.transform(mappings("parameters"), lambda p: F.struct(text(p, "name").alias("name"), text(p, "type").alias("type"), F.coalesce((kind(p, "required") == "bool") & (text(p, "required") == "true"), F.lit(False)).alias("required"))).alias("parameters"),
        F.when(kind("executor") == "map", F.struct(text("executor", "resource").alias("resource"), F.coalesce(receipts, F.when(receipt["text"].isNotNull(), F.array(receipt["text"])), F.array().cast("array<string>")).alias("receipt"))).alias("executor"),
        F.when(kind("attester") == "map", F.struct(text("attester", "resource").alias("resource"))).alias("attester"),
    )
    valid = F.filter("verified", lambda v: v["valid"])
    newest = F.aggregate(valid, F.lit(None).cast(out.schema["verified"].dataType.elementType), lambda best, v: F.when(best.isNull() | (F.struct(v["moment"]["second"], v["moment"]["nano"]) >= F.struct(best["moment"]["second"], best["moment"]["nano"])), v).otherwise(best))
    tier = F.when(F.exists(valid, lambda v: v["by_kind"] == "human"), 2).when(F.size(valid) > 0, 1).otherwise(0)
    return out.select(
        "*",
        tier.alias("tier_rank"),
        tier_name(tier).alias("trust_tier"),
        newest.alias("latest_verification"),
        F.coalesce(F.col("generated.at"), F.col("timestamp")).alias("content_changed_at"),
        F.coalesce("title", F.element_at("id_segs", -1)).alias("display_title"),
        (F.col("type").eqNullSafe(CONTRACT_TYPE)).alias("is_contract"),
        F.filter(F.transform("fm", lambda e: F.when(e["is_text"] & ~e["key"].isin(*KNOWN_KEYS), e["key"])), lambda k: k.isNotNull()).alias("extension_keys"),
        F.filter(F.transform("fm", lambda e: F.when(e["is_text"] & (e["key"] == "timestamp"), e["key"])), lambda k: k.isNotNull()).alias("legacy_keys"),
    )


def contracts(concepts: DataFrame) -> DataFrame:
    """Attested computations: a file wins over a block in the body, and having both is noted."""
    path = F.when(~blank(F.col("computation")), F.col("computation"))
    block = F.col("inline").isNotNull()
    return concepts.where("is_contract").select(
        "bundle", "id", "id_segs", "path_segs", "rel_path", "display_title", "parameters", "executor", "attester",
        F.when(~blank(F.col("runtime")), F.col("runtime")).alias("runtime"),
        F.when(path.isNotNull(), "file").when(block, "inline").otherwise("missing").alias("source"),
        path.alias("path"),
        F.when(path.isNull(), F.col("inline.code")).alias("code"),
        F.when(path.isNull(), F.col("inline.language")).alias("language"),
        (path.isNotNull() & block).alias("has_redundant_inline"),
        F.filter("parameters", lambda p: p["required"]).alias("required_parameters"),
    )


def reordered(concepts: DataFrame) -> DataFrame:
    """``bundle, id, keys``: frontmatter keys with the preferred ones first and the rest as they stand."""
    place = F.create_map(*(F.lit(x) for i, k in enumerate(PREFERRED_KEYS) for x in (k, i)))
    marked = F.transform("fm", lambda e, i: F.struct(F.coalesce(F.try_element_at(place, e["key"]), F.lit(99)).alias("p"), i.alias("i"), e["key"].alias("key")))
    return concepts.select("bundle", "id", F.array_sort(marked)["key"].alias("keys"))


def path_fields() -> Column:
    """``field, raw`` of each path-valued field that is not blank."""
    fields = (("resource", text("resource")), ("computation", text("computation")), ("executor.resource", F.col("executor.resource")), ("attester.resource", F.col("attester.resource")))
    made = F.array(*(F.when(~blank(value), F.struct(F.lit(name).alias("field"), value.alias("raw"))) for name, value in fields))
    return F.filter(made, lambda f: f.isNotNull())
