"""From files to parsed rows: one pass of Python over each file, everything after it is DataFrame code."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, markdown
from ..functions import yaml_subset as yaml
from ..functions.columns import STEP, valid_id

PARSED = (
    "bundle string, rel_path string, role string, utf8_ok boolean, error_kind string, yaml_line int, error string, has_frontmatter boolean, "
    "body string, text string, fm array<struct<key:string,is_text:boolean,kind:string,text:string,empty:boolean,canon:string,yaml:string,nan:boolean>>, "
    "node map<string,struct<kind:string,text:string,empty:boolean,n:int,day:int,moment:struct<day:int,has_time:boolean,second:long,nano:int,text:string>>>, "
    "links array<struct<text:string,raw:string,decoded:string>>, refs array<struct<label:string,line:int>>, "
    "defs array<struct<label:string,text:string,line:int>>, citations array<struct<number:long,text:string,target:string,raw:string>>, "
    "inline struct<code:string,language:string,fenced:boolean>, front string"
)


_LONG, _INT, _TEXT, _FLAG = pa.int64(), pa.int32(), pa.string(), pa.bool_()
_MOMENT = pa.struct({"day": _INT, "has_time": _FLAG, "second": _LONG, "nano": _INT, "text": _TEXT})
#: The same columns for Arrow.
_BATCH = pa.schema({
    "bundle": _TEXT, "rel_path": _TEXT, "role": _TEXT, "utf8_ok": _FLAG, "error_kind": _TEXT, "yaml_line": _INT, "error": _TEXT, "has_frontmatter": _FLAG, "body": _TEXT, "text": _TEXT,
    "fm": pa.list_(pa.struct({"key": _TEXT, "is_text": _FLAG, "kind": _TEXT, "text": _TEXT, "empty": _FLAG, "canon": _TEXT, "yaml": _TEXT, "nan": _FLAG})),
    "node": pa.map_(_TEXT, pa.struct({"kind": _TEXT, "text": _TEXT, "empty": _FLAG, "n": _INT, "day": _INT, "moment": _MOMENT})),
    "links": pa.list_(pa.struct({"text": _TEXT, "raw": _TEXT, "decoded": _TEXT})), "refs": pa.list_(pa.struct({"label": _TEXT, "line": _INT})),
    "defs": pa.list_(pa.struct({"label": _TEXT, "text": _TEXT, "line": _INT})), "citations": pa.list_(pa.struct({"number": _LONG, "text": _TEXT, "target": _TEXT, "raw": _TEXT})),
    "inline": pa.struct({"code": _TEXT, "language": _TEXT, "fenced": _FLAG}), "front": _TEXT,
})


def flatten(value, path: str, out: dict) -> None:
    """Every value inside ``value`` by its path; the first of repeated keys wins, other than text keys have none."""
    items = value.items if isinstance(value, yaml.Pairs) else value if isinstance(value, list) else ()
    out.setdefault(path, (yaml.kind_of(value), yaml.display(value), yaml.is_empty(value), len(items)))
    done = set()
    for i, item in enumerate(items):
        key, inner = item if isinstance(value, yaml.Pairs) else (str(i), item)
        if isinstance(key, str) and key not in done:
            done.add(key)
            flatten(inner, f"{path}{STEP}{key}" if path else key, out)


def _has_nan(value) -> bool:
    if isinstance(value, yaml.Pairs):
        return any(_has_nan(k) or _has_nan(v) for k, v in value.items)
    return any(map(_has_nan, value)) if isinstance(value, list) else value != value


def serialized(front: str, body: str) -> str:
    """A document written back in its normal form."""
    return f"---\n{front}\n---\n\n{body}" + ("" if body.endswith("\n") else "\n")


def with_serialized(rows: DataFrame) -> DataFrame:
    """The same of parsed rows: bodies are kept once and written back where they are read."""
    body = F.col("body")
    return rows.withColumn("serialized", F.concat(F.lit("---\n"), "front", F.lit("\n---\n\n"), body, F.when(body.endswith("\n"), "").otherwise("\n")))


def parse_file(bundle: str, rel_path: str, content: bytes) -> dict:
    name = rel_path.rpartition("/")[2]
    role = {"index.md": "index", "log.md": "log"}.get(name, "concept")
    row: dict = {"bundle": bundle, "rel_path": rel_path, "role": role, "utf8_ok": True, "has_frontmatter": False, "fm": [], "node": {}}
    try:
        text = (content or b"").decode("utf-8")
    except UnicodeDecodeError:
        return row | {"utf8_ok": False, "error_kind": "utf8", "error": "stream did not contain valid UTF-8"}
    front, body, error = markdown.split_document(text)
    pairs = yaml.Pairs()
    row["text"] = text if role == "log" else None
    if error:
        row |= {"error_kind": "unterminated", "error": error}
    elif front is not None:
        try:
            value = yaml.parse(front)
            if isinstance(value, yaml.Pairs):
                pairs = value
            elif value is not None:
                row |= {"error_kind": "not_mapping", "error": "Frontmatter must be a YAML mapping"}
        except yaml.YamlError as e:
            row |= {"error_kind": "yaml", "yaml_line": e.line, "error": f"Invalid YAML in frontmatter: {e}"}
    if row.get("error"):
        return row
    nodes: dict = {}
    flatten(pairs, "", nodes)
    nodes.pop("")
    refs, defs = markdown.footnotes(body)
    written = yaml.emit(pairs).rstrip()
    return row | {
        "has_frontmatter": bool(pairs.items),
        "body": body,
        "fm": [{"key": yaml.display(k) or yaml.inline(k), "is_text": isinstance(k, str), "kind": yaml.kind_of(v), "text": yaml.display(v), "empty": yaml.is_empty(v), "canon": yaml.canonical(v), "yaml": yaml.emit(v).strip("\n"), "nan": _has_nan(v)} for k, v in pairs.items],
        "node": {p: {"kind": k, "text": t, "empty": e, "n": n, "day": dates.epoch_day(t.strip()) if t else None, "moment": dates.instant(t) if t else None} for p, (k, t, e, n) in nodes.items()},
        "links": [{"text": t, "raw": r, "decoded": d} for t, r, d in markdown.links(body)],
        "refs": [{"label": a, "line": n} for a, n in refs],
        "defs": [{"label": a, "text": t, "line": n} for a, t, n in defs],
        "citations": [{"number": n, "text": t, "target": g, "raw": r} for n, t, g, r in markdown.citations(body)],
        "inline": dict(zip(("code", "language", "fenced"), made, strict=True)) if (made := markdown.computation(body)) else None,
        "front": written,
        "serialized": serialized(written, body),
    }


def digest() -> Column:
    """Of a file's content."""
    return F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("digest")


def parsed(files: DataFrame, keep: str | None = None) -> DataFrame:
    """A row for each markdown file of ``bundle, rel_path, content``, with ``path_segs`` and, for concepts, ``id`` and ``id_segs``;
    ``keep`` (a name and a type) is a further column that stays."""
    kept = keep.split()[0] if keep else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [parse_file(*r) for r in zip(*(part.column(c).to_pylist() for c in ("bundle", "rel_path", "content")), strict=True)]
                for r in rows:
                    r["node"] = list(r["node"].items())
                made = pa.RecordBatch.from_pylist(rows, schema=_BATCH)
                yield pa.RecordBatch.from_arrays([*made.columns, part.column(kept)], names=[*_BATCH.names, kept]) if kept else made

    rows = files.where(F.element_at(F.split("rel_path", "/"), -1).rlike(r"(?s).\.md\z")).select("bundle", "rel_path", "content", *([kept] if kept else [])).mapInArrow(run, PARSED + (f", {keep}" if keep else ""))
    segs = F.split("rel_path", "/")
    rows = with_serialized(rows).withColumn("path_segs", segs)
    own = valid_id(F.transform(segs, lambda s, i: F.when(i == F.size(segs) - 1, F.regexp_replace(s, r"\.md$", "")).otherwise(s)))
    rows = rows.withColumn("id_segs", F.when(F.col("role") == "concept", own)).withColumn("id", F.array_join("id_segs", "/"))
    wrong = (F.col("role") == "concept") & F.col("id_segs").isNull() & F.col("error").isNull()
    return rows.withColumn("error_kind", F.when(wrong, "concept_id").otherwise(F.col("error_kind"))).withColumn("error", F.when(wrong, F.concat(F.lit("Invalid concept id: "), F.col("rel_path"))).otherwise(F.col("error")))
