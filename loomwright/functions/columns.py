"""Column expressions: paths, links, dates, actors, texts. No Python runs in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between the steps of a path into a frontmatter value.
STEP = "\x1f"
_SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def blank(text: Column) -> Column:
    return trimmed(text) == ""


def quoted(text: Column) -> Column:
    """Text in double quotes with its special characters escaped."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, escaped in (('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\x00", "\\0")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# --- links and paths


def link_kind(target: Column) -> Column:
    return once(trimmed(target), lambda t: (
        F.when(t == "", "other").when(t.startswith("#"), "anchor").when(t.rlike(r"^(//|[A-Za-z][A-Za-z0-9+.\-]*:)"), "external")
        .when(t.startswith("/"), "absolute").otherwise("relative")
    ))


def without_anchor(target: Column) -> Column:
    return F.substring_index(target, "#", 1)


def segments(path: Column, base: Column) -> Column:
    """Steps of ``path`` from ``base``; null where ``..`` leaves the root."""
    none = F.lit(None).cast("array<string>")
    step = lambda acc, s: (
        F.when(acc.isNull(), none).when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == "..", none).otherwise(F.concat(acc, F.array(s)))
    )
    return F.aggregate(F.split(path, "/", -1), base.cast("array<string>"), step)


def valid_id(segs: Column) -> Column:
    """The steps, or null if they cannot be an id."""
    bad = F.exists(segs, lambda s: (s == "") | s.isin(".", "..") | s.rlike(r"[/\\]|\p{Cc}"))
    return F.when((F.size(segs) > 0) & ~bad, segs)


def parent(segs: Column) -> Column:
    return F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))


def without_md(segs: Column) -> Column:
    return F.when(F.size(segs) > 0, F.concat(parent(segs), F.array(F.regexp_replace(F.element_at(segs, -1), r"\.md$", ""))))


def link_ids(target: Column, kind: Column, source: Column) -> Column:
    """Ids that a link target can mean when read as it stands: none or one, as an array."""
    base = F.when(kind == "absolute", F.array().cast("array<string>")).otherwise(parent(source))
    reads = kind.isin("absolute", "relative") & ~target.endswith("/") & ((kind == "absolute") | (target != ""))
    return F.when(reads, once(segments(target, base), lambda s: once(without_md(s), valid_id)))


def field_paths(raw: Column, source: Column) -> Column:
    """Paths in the bundle that a path field can mean: from its concept's folder, then from the root."""
    target = trimmed(raw)
    kind, bare = link_kind(target), without_anchor(trimmed(raw))
    root = F.array_join(segments(bare, F.array().cast("array<string>")), "/")
    here = F.array_join(segments(bare, parent(source)), "/")
    both = F.array_distinct(F.filter(F.array(here, root), lambda p: p.isNotNull() & (p != "")))
    return F.when(kind == "absolute", F.filter(F.array(root), lambda p: p.isNotNull())).when(kind == "relative", both).otherwise(F.array().cast("array<string>"))


def names_concept(raw: Column) -> Column:
    """Whether an index link can name a concept: no anchor, no address, and .md or no dot in its last step."""
    t = trimmed(raw)
    last = F.element_at(F.split(F.substring_index(t, "#", 1), "/", -1), -1)
    return (t != "") & ~t.startswith("#") & (link_kind(t) != "external") & (last.endswith(".md") | ~last.contains("."))


# --- dates


def strict_date(text: Column) -> Column:
    """Date of a text that is exactly YYYY-MM-DD, else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


# --- actors, tiers, states


def actor_kind(raw: Column) -> Column:
    t = trimmed(raw)
    return F.when(t.rlike("(?s)^human:."), "human").when(t.rlike("(?s)^process:."), "process").when(t.rlike("(?s)^[^/]+/[^/]+$"), "agent").otherwise("other")


TIERS = ("unverified", "machine-confirmed", "human-reviewed")


def tier_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), rank + 1)


def resource_kind(resource: Column) -> Column:
    t = trimmed(resource)
    return F.when(resource.isNull() | (t == ""), "missing").when(t.contains("://") | t.startswith("mailto:"), "url").when(t.rlike(_SPACE), "scope").otherwise("path")


def type_label(kind: Column) -> Column:
    """How a message calls a kind of value."""
    names = {"null": "null", "bool": "a boolean", "int": "an integer", "float": "a float", "string": "a string", "list": "a list", "map": "a mapping"}
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), kind)


def portable(segment: Column) -> Column:
    return segment.rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.\-]*\z")


def markdown_escaped(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "\n\r", "  "), r"([\\\[\]<>&])", r"\\$1")


def percent_encoded(text: Column) -> Column:
    """Every UTF-8 byte outside unreserved characters and the slash as %XX."""
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1))), lambda i: F.substring(F.hex(F.encode(text, "utf-8")), i * 2 - 1, F.lit(2)))
    shown = F.transform(codes, lambda h: F.when(F.decode(F.unhex(h), "iso-8859-1").rlike(r"^[A-Za-z0-9\-._~/]$"), F.decode(F.unhex(h), "iso-8859-1")).otherwise(F.concat(F.lit("%"), h)))
    return F.when(text == "", "").otherwise(F.array_join(shown, ""))
