"""Reports as text: graphs, listings and the like. Lines are made by columns and sorted; joining them is the sink's work."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.ordering import numbered_within
from ..sources.joined import write_joined
from .bundle import Bundle

_SECTION = r"§[0-9]+(?:\.[0-9]+)*"
_GROUP = re.compile(rf" ?\(\s*{_SECTION}\s*(?:(?:,|to)\s*{_SECTION}\s*)*\)")


def without_sections(text: str) -> str:
    """A message without its references to sections of the format's description."""
    text = _GROUP.sub("", text)
    out = ""
    at = 0
    for m in re.finditer(_SECTION, text):
        out += text[at : m.start()]
        at = m.end()
        if out.endswith(" ") and text[at : at + 1].isspace():
            at += 1
    return (out + text[at:]).rstrip()


def diagnostic_line() -> Column:
    """``[severity] path or concept: message``."""
    where = F.coalesce("path", "concept")
    return F.concat(F.lit("["), "severity", F.lit("] "), F.when(where.isNotNull(), F.concat(where, F.lit(": "))).otherwise(""), "message")


def graph_text(bundle: Bundle, sources: bool = False) -> DataFrame:
    """``line`` in order of ``path_segs, part, seq``: concepts with edges, and their edges."""
    edge = F.concat(F.when(F.col("exists"), F.lit("  -> ")).otherwise("  -x "), "target_id")
    lines = bundle.links.select("bundle", F.col("src_path").alias("path_segs"), F.col("src_id").alias("id"), F.lit(1).alias("part"), "seq", edge.alias("line"))
    if sources:
        made = graph.derivations(bundle.sources)
        lines = lines.unionByName(made.select("bundle", F.col("src_path").alias("path_segs"), F.col("src_id").alias("id"), F.lit(2).alias("part"), "seq", F.concat(F.lit("  ~> "), "concept_id", F.lit(" (source)")).alias("line")))
    heads = lines.select("bundle", "path_segs", "id").distinct().select("bundle", "path_segs", "id", F.lit(0).alias("part"), F.lit(0).alias("seq"), F.col("id").alias("line"))
    return heads.unionByName(lines).orderBy("bundle", "path_segs", "part", "seq").select("bundle", "path_segs", "part", "seq", "line")


def node_numbers(bundle: Bundle) -> DataFrame:
    """``bundle, id, n``: nodes numbered by first appearance, a concept before the targets of its links."""
    own = bundle.concepts.select("bundle", "id", F.struct("path_segs", F.lit(-1).alias("seq")).alias("at"))
    targets = bundle.links.select("bundle", F.col("target_id").alias("id"), F.struct(F.col("src_path").alias("path_segs"), "seq").alias("at"))
    first = own.unionByName(targets).groupBy("bundle", "id").agg(F.min("at").alias("at"))
    return numbered_within(first, "bundle", "at", name="n").select("bundle", "id", "at", "n")


def graph_mermaid(bundle: Bundle, sources: bool = False) -> DataFrame:
    """``bundle, part, a, b, line`` in order: a flowchart."""
    nodes = node_numbers(bundle)
    label = F.replace(F.replace(F.replace(F.replace("id", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit("#quot;")), F.lit("["), F.lit("&#91;")), F.lit("]"), F.lit("&#93;"))
    name = lambda n: F.concat(F.lit("n"), n.cast("string"))
    head = bundle.concepts.select("bundle").distinct().select("bundle", F.lit(0).alias("part"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit("flowchart LR").alias("line"))
    shown = nodes.select("bundle", F.lit(1).alias("part"), F.col("n").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.concat(F.lit("  "), name(F.col("n")), F.lit('["'), label, F.lit('"]')).alias("line"))
    of = lambda alias: nodes.select(F.col("bundle"), F.col("id").alias(f"{alias}_id"), F.col("n").alias(f"{alias}_n"))
    edges = bundle.links.select("bundle", F.col("src_id").alias("f_id"), F.col("target_id").alias("t_id"), F.lit(0).alias("b"), "seq", F.when(F.col("exists"), "-->").otherwise("-.->|broken|").alias("arrow"))
    if sources:
        edges = edges.unionByName(graph.derivations(bundle.sources).select("bundle", F.col("src_id").alias("f_id"), F.col("concept_id").alias("t_id"), F.lit(1).alias("b"), "seq", F.lit("-.->|source|").alias("arrow")))
    order = numbered_within(bundle.concepts.select("bundle", "path_segs", F.col("id").alias("f_id")), "bundle", "path_segs", name="a").select("bundle", "f_id", (F.col("a") + 1).alias("a"))
    edges = edges.join(of("f"), ["bundle", "f_id"]).join(of("t"), ["bundle", "t_id"]).join(order, ["bundle", "f_id"])
    arrows = edges.select("bundle", F.lit(2).alias("part"), "a", "b", F.col("seq").alias("c"), F.concat(F.lit("  "), name(F.col("f_n")), F.lit(" "), "arrow", F.lit(" "), name(F.col("t_n"))).alias("line"))
    return head.unionByName(shown).unionByName(arrows).orderBy("bundle", "part", "a", "b", "c")


def graph_rows(bundle: Bundle, sources: bool = False) -> DataFrame:
    """``bundle, path_segs, id, links, sources``: a row for each concept with its edges in order."""
    out = bundle.links.groupBy("bundle", F.col("src_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("seq", F.struct(F.col("target_id").alias("target"), "exists", "text", "raw").alias("l")))).alias("links"))
    rows = bundle.concepts.select("bundle", "path_segs", "id").join(out, ["bundle", "id"], "left").withColumn("links", F.col("links.l"))
    if not sources:
        return rows.withColumn("sources", F.lit(None).cast("array<string>"))
    made = graph.derivations(bundle.sources).groupBy("bundle", F.col("src_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("seq", "concept_id")))["concept_id"].alias("sources"))
    return rows.join(made, ["bundle", "id"], "left")


# Characters that JSON writes by a name (fixed values).
_NAMED = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _json(text: Column) -> Column:
    """A text as JSON writes it: quotes, backslashes and control characters escaped, all else as it is."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rare = plain
    for c in map(chr, range(32)):
        rare = F.replace(rare, F.lit(c), F.lit(_NAMED.get(c, f"\\u{ord(c):04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), rare).otherwise(plain), F.lit('"'))


def graph_json_blocks(bundle: Bundle, sources: bool = False) -> DataFrame:
    """``bundle, path_segs, block``: the JSON text of each concept in a fixed layout."""
    link = lambda k: F.concat(F.lit('        {\n          "target": '), _json(k["target"]), F.lit(',\n          "exists": '), k["exists"].cast("string"), F.lit(',\n          "text": '), _json(k["text"]), F.lit(',\n          "raw": '), _json(k["raw"]), F.lit("\n        }"))
    shown = F.when(F.coalesce(F.size("links"), F.lit(0)) > 0, F.concat(F.lit("[\n"), F.array_join(F.transform("links", link), ",\n"), F.lit("\n      ]"))).otherwise("[]")
    own = F.array_join(F.transform(F.coalesce("sources", F.array().cast("array<string>")), _json), ", ")
    block = F.concat(F.lit('    {\n      "id": '), _json(F.col("id")), F.lit(',\n      "links": '), shown, F.lit(',\n      "sources": ['), own, F.lit("]\n    }"))
    return graph_rows(bundle, sources).select("bundle", "path_segs", block.alias("block"))


_JSON_HEAD, _JSON_TAIL = '{\n  "concepts": [\n', "  ]\n}\n"


def graph_json(bundle: Bundle, sources: bool = False) -> str:
    """The same of a small bundle as one JSON text."""
    return "".join(graph_json_pieces(bundle, sources))


def graph_json_pieces(bundle: Bundle, sources: bool = False) -> Iterator[str]:
    """The pieces of that text, a concept at a time."""
    yield _JSON_HEAD
    first = True
    for r in graph_json_blocks(bundle, sources).orderBy("bundle", "path_segs").toLocalIterator():
        yield r.block if first else ",\n" + r.block
        first = False
    yield _JSON_TAIL if first else "\n" + _JSON_TAIL


def write_graph_json(bundle: Bundle, path: str, sources: bool = False) -> None:
    """The same as a file, written by tasks."""
    blocks = graph_json_blocks(bundle, sources)
    some = not bundle.concepts.isEmpty()
    write_joined(blocks, "block", "bundle", "path_segs", path=path, head=_JSON_HEAD, between=",\n", tail="\n" + _JSON_TAIL if some else _JSON_TAIL)


def event_text(event) -> str:
    """A generation or verification: who and when."""
    return f"{event.by} at {event.at}" if event.by is not None and event.at is not None else event.by if event.by is not None else f"(unknown) at {event.at}" if event.at is not None else "(unknown)"


def source_text(source) -> str:
    label = next((x for x in (source.title, source.resource, source.id) if x is not None), "(unnamed source)")
    return f"[{source.id}] {label}" if source.id is not None else label


def parameter_text(p) -> str:
    return (p.name if p.name is not None else "(unnamed)") + (f": {p.type}" if p.type is not None else "") + (" (required)" if p.required else "")
