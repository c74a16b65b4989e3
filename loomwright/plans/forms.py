"""A bundle of unusual forms, a file for each document, and what must be read from each: links, values and broken files
that the plain written corpus does not have.

Document n takes form n modulo their number; ``{n}`` in a form stands for n. What is expected is written out by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FRONT = "---\ntype: Note\ntitle: T{n}\n---\n\n# H\n\n"


def _front(lines: str, body: str = "# H\n\nText.\n") -> str:
    return f"---\ntype: Note\n{lines}\n---\n\n{body}"


#: (path, content) of each form.
FORMS: tuple[tuple[str, str], ...] = (
    ("v0/n{n}.md", _FRONT + "See ![alt](/v0/n{n}.md).\n"),
    ("v1/n{n}.md", _FRONT + "\\[no](x.md) \\\\[yes](/v1/n{n}.md)\n"),
    ("v2/n{n}.md", _FRONT + "[a [b] c](/v2/n{n}.md)\n"),
    ("v3/n{n}.md", _FRONT + "[p](/v3/x(1).md)\n"),
    ("v4/my notes{n}.md", _FRONT + "[e](/v4/my%20notes{n}.md#part)\n"),
    ("v5/n{n}.md", _FRONT + "```\n[no](/v5/n{n}.md)\n```\n[yes](/v5/n{n}.md)\n~~~\n[no](a.md)\n"),
    ("v6/n{n}.md", _FRONT + "`[no](a.md)` [yes](/v6/n{n}.md 'title')\n"),
    ("v7/n{n}.md", _FRONT + "[w](</v7/with space{n}.md>)\n"),
    ("v8/a/b/c/n{n}.md", _FRONT + "[up](../../d/e.md) [out](../../../../../x.md) [web](https://example.com/a(b))\n"),
    ("v9/n{n}.md", "---\r\ntype: Note\r\ntitle: T{n}\r\ndescription: one\r\n---\r\n\r\n# H\r\n\r\nText.\r\n"),
    ("v10/n{n}.md", _front("title: T{n}\ndescription: |\n  line one\n  line {n}\n")),
    ("v11/n{n}.md", _front("title: T{n}\ndescription: >-\n  a\n  b{n}\n\n  c\n")),
    ("v12/n{n}.md", _front('title: "q\\"t\\u00e9\\n{n}"')),
    ("v13/n{n}.md", _front("title: 'it''s {n}'\ndescription: T # note")),
    ("v14/n{n}.md", _front("title: T{n}\ntags: [a, 'b, c', \"d\", {n}]")),
    ("v15/n{n}.md", _front("title: one\n  two\n  {n}\ntags:\n- x\n- y z\n")),
    ("v16/n{n}.md", _front("title: T{n}\nverified:\n- { by: human:a, at: '2026-06-20T09:00:00+02:00' }\n- { by: process:b, at: 2026-06-20T07:30:00Z }\n- { by: human:c, at: 2026-06-20T06:59:59.5Z }")),
    ("v17/n{n}.md", "---\ntype: Note\ntitle: T{n}\n"),
    ("v18/n{n}.md", "---\ntype: Note\nsources:\n\t- a\n---\n"),
    ("v19/n{n}.md", "---\n- a{n}\n---\n"),
    ("v20/n{n}.md", _front("title: T{n}\ngenerated: yesterday")),
    ("v21/n{n}.md", _front("title: T{n}\nusage_window: { from: 2026-01-01, to: 2026-02-01 }")),
    ("v22/n{n}.md", _front("title: T{n}\nsources:\n- plain\n- { id: s, resource: a.md }\n- { id: s, resource: b.md, usage_count: many }")),
    ("v23/n{n}.md", _front("title: T{n}", "")),
    ("v24/n{n}.md", _front("title: T{n}", "Just prose.\n")),
    ("v25/n{n}/index.md", "---\ntitle: no\n---\n\n# Parts\n"),
    ("v26/n{n}.md", _front("title: T{n}\na: " + "[" * 101 + "]" * 101)),
    ("v27/n{n}.md", _front("title: T{n}\ngenerated: { at: '2026-01-01T00:00:00Z' }")),
    ("v28/n{n}.md", _front("title: T{n}\ngenerated: { by: human:a, at: 2026-01-01 }")),
    ("v29/n{n}.md", _front("title: T{n}\nsources: plain")),
    ("v30/n{n}.md", _front("title: T{n}\nusage_window: { from: soon, to: later{n} }\nsources:\n- { id: s, resource: a.md }")),
    ("v31/n{n}.md", _front("title: T{n}\nsources:\n- { id: s }\n- { id: t, resource: b.md, last_modified: never, usage_count: {n} }")),
)

#: (form, place, text, raw, target, exists) of every link that is a link.
LINKS = (
    (0, 0, "alt", "/v0/n{n}.md", "v0/n{n}", True), (1, 0, "yes", "/v1/n{n}.md", "v1/n{n}", True), (2, 0, "a [b] c", "/v2/n{n}.md", "v2/n{n}", True), (3, 0, "p", "/v3/x(1).md", "v3/x(1)", False),
    (4, 0, "e", "/v4/my%20notes{n}.md#part", "v4/my notes{n}", True), (5, 0, "yes", "/v5/n{n}.md", "v5/n{n}", True), (6, 0, "yes", "/v6/n{n}.md", "v6/n{n}", True),
    (7, 0, "w", "/v7/with space{n}.md", "v7/with space{n}", False), (8, 0, "up", "../../d/e.md", "v8/a/d/e", False),
)
#: (form, title, description, tags) of the forms that are about values.
VALUES = (
    (9, "T{n}", "one", ""), (10, "T{n}", "line one\nline {n}\n", ""), (11, "T{n}", "a b{n}\nc", ""), (12, 'q"té\n{n}', "-", ""), (13, "it's {n}", "T", ""),
    (14, "T{n}", "-", "a|b, c|d|{n}"), (15, "one two {n}", "-", "x|y z"),
)
#: (form, path, message) of the files that cannot be read, and their conformance finding.
BROKEN = (
    (17, "v17/n{n}.md", "unparseable concept document: Unterminated YAML frontmatter block"),
    (18, "v18/n{n}.md", "unparseable concept document: Invalid YAML in frontmatter: YAML error at line 3: tab character in indentation"),
    (19, "v19/n{n}.md", "unparseable concept document: Frontmatter must be a YAML mapping"),
    (26, "v26/n{n}.md", "unparseable concept document: Invalid YAML in frontmatter: YAML error at line 3: collections nested more than 100 deep"),
)
#: (form, code, message) of the findings under V5, V9, V10, V16 and V17.
FINDINGS = (
    (4, "V16", 'concept-id segment "my notes{n}" is outside the conventional `[A-Za-z0-9_][A-Za-z0-9_.-]*` set; the bundle is still conformant, but such a name needs `<...>` or percent-encoding to link portably and is not guaranteed to survive every filesystem unchanged (§2)'),
    (20, "V5", "`generated` should be a `{ by, at }` mapping, found a string (§5.2)"),
    (21, "V9", "`usage_window` is present without `sources` to frame (§5.1)"),
    (22, "V10", "`sources[0]` should be a mapping entry, found a string (§5.1)"),
    (22, "V10", 'duplicate `sources[].id` "s"; ids are the join key for attribution (§5.1)'),
    (22, "V10", "`sources[2].usage_count` should be an integer, found a string (§5.1)"),
    (27, "V5", "`generated.by` is required within `generated` (§5.2)"),
    (28, "V5", '`generated.at` is not an ISO-8601 datetime: "2026-01-01" (§5.2)'),
    (29, "V9", "`sources` should be a list of entries, found a string (§5.1)"),
    (30, "V9", '`usage_window.from` is not a `YYYY-MM-DD` date: "soon" (§5.1)'),
    (30, "V9", '`usage_window.to` is not a `YYYY-MM-DD` date: "later{n}" (§5.1)'),
    (31, "V10", "`sources[0].resource` is required within an entry (§5.1)"),
    (31, "V10", '`sources[1].last_modified` is not a `YYYY-MM-DD` date: "never" (§5.1)'),
    (31, "V10", "`sources[1].usage_count` has no `usage_window` to frame it (§5.1)"),
    (25, "V17", "index.md should not contain frontmatter (§8)"),
)
#: (form, code) of the health findings L7 and L8.
BODIES = ((23, "L7"), (24, "L8"))
#: Forms that no link and no index names.
ORPHANS = (3, 7, 8, *range(9, 17), *range(20, 25), *range(27, 32))
#: (form, normal form) of documents as written back.
WRITTEN = (
    (11, '---\ntype: Note\ntitle: T{n}\ndescription: "a b{n}\\nc"\n---\n\n# H\n\nText.\n'),
    (12, '---\ntype: Note\ntitle: "q\\"té\\n{n}"\n---\n\n# H\n\nText.\n'),
    (13, "---\ntype: Note\ntitle: it's {n}\ndescription: T\n---\n\n# H\n\nText.\n"),
    (14, "---\ntype: Note\ntitle: T{n}\ntags:\n  - a\n  - b, c\n  - d\n  - {n}\n---\n\n# H\n\nText.\n"),
    (15, "---\ntype: Note\ntitle: one two {n}\ntags:\n  - x\n  - y z\n---\n\n# H\n\nText.\n"),
    (16, '---\ntype: Note\ntitle: T{n}\nverified:\n  - by: human:a\n    at: "2026-06-20T09:00:00+02:00"\n  - by: process:b\n    at: "2026-06-20T07:30:00Z"\n  - by: human:c\n    at: "2026-06-20T06:59:59.5Z"\n---\n\n# H\n\nText.\n'),
)


def forms_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bundle, rel_path, content``: a file in its form for each document, and a root index."""
    forms = spark.createDataFrame([(v, *f) for v, f in enumerate(FORMS)], "v int, path string, content string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("n"), (F.col("doc_id") % len(FORMS)).cast("int").alias("v"))
    named = lambda c: F.replace(F.col(c), F.lit("{n}"), F.col("n").cast("string"))
    root = spark.createDataFrame([("forms", "index.md", "---\nokf_version: \"0.2\"\n---\n\n# Parts\n")], "bundle string, rel_path string, content string")
    return docs.join(forms, "v").select(F.lit("forms").alias("bundle"), named("path").alias("rel_path"), named("content").alias("content")).unionByName(root).withColumn("content", F.encode("content", "utf-8"))


def expected(rows: tuple[tuple, ...], *names: str) -> str:
    """SQL of ``rows``, whose first column is a form: a row for each document of that form."""
    text = lambda x: str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    shown = ", ".join(f"replace(e.{name}, '{{n}}', d.doc_id::VARCHAR) AS \"{name}\"" if isinstance(x, str) else f'e."{name}"' for name, x in zip(names, rows[0][1:], strict=True))
    own = "CASE WHEN v = 4 THEN 'v4/my notes' || d.doc_id WHEN v = 8 THEN 'v8/a/b/c/n' || d.doc_id WHEN v = 25 THEN 'v25/n' || d.doc_id || '/index' ELSE 'v' || v || '/n' || d.doc_id END"
    return f"SELECT {own} AS id{', ' if shown else ''}{shown} FROM documents d JOIN (VALUES {values}) e(v{''.join(', ' + n for n in names)}) ON d.doc_id % {len(FORMS)} = e.v"
