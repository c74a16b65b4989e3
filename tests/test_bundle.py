"""Graphs, typed columns, indexes, snapshots, sources and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomwright.functions import columns as c
from loomwright.operators import diff, graph, indexes, logs
from loomwright.plans import render
from loomwright.plans.bundle import Bundle, UnreadableConcept
from loomwright.sources.bundle import NotABundle, from_rows, listed, read_lake, read_tree
from loomwright.streaming import snapshots

FINANCE = {
    "index.md": '---\nokf_version: "0.2"\n---\n\n# All\n\n* [s](metrics/income-statement.md)\n',
    "metrics/income-statement.md": "---\ntype: Metric\ntitle: Income statement\ndescription: All of it\ntags: [finance]\ngenerated: { by: writer/1, at: 2026-06-20T22:53:05Z }\n---\n\n# Income\n\nSee [revenue](/computations/revenue.md), then [profit](../computations/profit.md#x).\n",
    "computations/revenue.md": "---\ntype: Attested Computation\ntitle: Revenue\ntags: [finance, money]\nruntime: bigquery-sql\nparameters:\n- { name: year, type: integer, required: true }\n- name: region\nexecutor: { resource: ../references/skills/run-on-bq.md, receipt: [job id, rows] }\nattester: { resource: /references/check.py }\nverified:\n- { by: process:nightly, at: 2026-06-01T00:00:00Z }\n- { by: human:ada, at: 2026-06-01T02:00:00+02:00 }\nstale_after: 2026-09-23\nsources:\n- { id: base, resource: ../metrics/income-statement.md }\n- { id: self, resource: revenue.md }\n- { id: web, resource: https://example.com/a, author: team:x, usage_count: 12, usage_window: { from: 2026-01-01, to: 2026-02-01 } }\n- { resource: all of 2025 }\n---\n\n# Computation\n\n```sql\nSELECT sum(x)\n\nFROM t\n```\n\nBased on[^base] and[^none].\n\n[^base]: The statement\n",
    "computations/profit.md": "---\ntype: Attested Computation\ntitle: Profit\ntags: [finance]\nruntime: dbt\ncomputation: models/profit.sql\nverified: { by: process:nightly, at: 2026-06-01T00:00:00Z }\nstale_after: 2026-06-15\nstatus: '  draft '\n---\n\n# Profit\n\n[revenue](revenue.md) [revenue again](revenue.md) [me](profit.md)\n",
    "references/skills/run-on-bq.md": "---\ntype: Skill\n---\n\n# How\n",
    "references/check.py": "print()",
    "log.md": "# Changes\n\n## 2026-06-02\n* **Update**: profit\n* plain\n\n## 2026-06-01\n- **Creation** all\n",
}


@pytest.fixture(scope="module")
def finance(spark):
    bundle = Bundle(from_rows(spark, FINANCE.items()))
    yield bundle
    bundle.release()


def test_typed_columns(finance):
    got = {r.id: r for r in finance.concepts.collect()}
    assert len(got) == 4
    revenue, profit = got["computations/revenue"], got["computations/profit"]
    assert [got[i].trust_tier for i in ("metrics/income-statement", "computations/revenue", "computations/profit")] == ["unverified", "human-reviewed", "machine-confirmed"]
    assert revenue.latest_verification.by == "human:ada"  # of equal instants the last
    assert profit.status == "draft" and revenue.status == "stable"
    assert [s.id for s in revenue.sources] == ["base", "self", "web", None]
    assert revenue.sources[2].usage_count == 12 and str(revenue.sources[2].usage_window["from"].date) == "2026-01-01"
    assert got["references/skills/run-on-bq"].display_title == "run-on-bq" and got["metrics/income-statement"].content_changed_at == "2026-06-20T22:53:05Z"
    assert {r.id for r in finance.stale_on("2026-07-01").collect()} == {"computations/profit"}
    assert finance.of_type("Skill").count() == 1 and finance.version.first().version == "0.2"


def test_graphs(finance):
    assert [(r.target_id, r.exists) for r in finance.links_from("metrics/income-statement").collect()] == [("computations/revenue", True), ("computations/profit", True)]
    back = {}
    for r in finance.backlinks().collect():
        back.setdefault(r.target_id, set()).add(r.src_id)
    assert back == {"computations/revenue": {"metrics/income-statement", "computations/profit"}, "computations/profit": {"metrics/income-statement", "computations/profit"}}
    assert [(r.src_id, r.concept_id) for r in graph.derivations(finance.sources).collect()] == [("computations/revenue", "metrics/income-statement")]
    assert [r.src_id for r in finance.derives("metrics/income-statement").collect()] == ["computations/revenue"]
    assert {r.tag: r.ids for r in finance.tags().collect()} == {"finance": ["computations/profit", "computations/revenue", "metrics/income-statement"], "money": ["computations/revenue"]}
    assert finance.broken_links().count() == 0


def test_attributions_and_contracts(finance):
    notes = {r.label: r for r in finance.attributions.collect()}
    assert notes["base"].source.resource == "../metrics/income-statement.md" and notes["none"].source is None and notes["none"].n_defs == 0
    by = {r.id: r for r in finance.contracts.collect()}
    assert by["computations/revenue"].code == "SELECT sum(x)\n\nFROM t" and by["computations/revenue"].language == "sql"
    assert [p.name for p in by["computations/revenue"].required_parameters] == ["year"]
    assert (by["computations/profit"].source, by["computations/profit"].path) == ("file", "models/profit.sql")
    assert [render.parameter_text(p) for p in by["computations/revenue"].parameters] == ["year: integer (required)", "region"]


def test_summary_and_groups(finance):
    n = {r.measure: r.value for r in finance.summary("2026-07-01").collect()}
    assert n == {"concepts": 4, "with_sources": 1, "computations": 2, "stale": 1, "index_files": 1, "log_files": 1, "links": 5, "derivation_edges": 1, "tags": 2}
    assert {(r.what, r.name): r.n for r in finance.groups().collect()}[("type", "Attested Computation")] == 2


def test_logs(finance):
    assert [(r.date_text, r.pos, r.kind, r.text) for r in finance.log_entries().orderBy("day", "pos").collect()] == [("2026-06-02", 1, "Update", "profit"), ("2026-06-02", 2, None, "plain"), ("2026-06-01", 1, "Creation", "all")]
    assert logs.to_markdown(finance.logs).first().markdown == "# Changes\n\n## 2026-06-02\n* **Update**: profit\n* plain\n\n## 2026-06-01\n* **Creation**: all\n"


def test_renderers(finance):
    lines = [r.line for r in render.graph_text(finance, True).collect()]
    assert lines == ["computations/profit", "  -> computations/revenue", "  -> computations/revenue", "  -> computations/profit", "computations/revenue", "  ~> metrics/income-statement (source)", "metrics/income-statement", "  -> computations/revenue", "  -> computations/profit"]
    chart = [r.line for r in render.graph_mermaid(finance).collect()]
    assert chart[:3] == ["flowchart LR", '  n0["computations/profit"]', '  n1["computations/revenue"]'] and "  n0 --> n1" in chart
    made = json.loads(render.graph_json(finance, True))
    assert [x["id"] for x in made["concepts"]] == ["computations/profit", "computations/revenue", "metrics/income-statement", "references/skills/run-on-bq"]
    assert made["concepts"][1]["sources"] == ["metrics/income-statement"]


def test_exact_graph_json(spark):
    b = Bundle(from_rows(spark, [("source.md", '---\ntype: A\n---\n[a "quote"](target.md#x"y)\n'), ("target.md", "---\ntype: A\n---\n")]))
    assert render.graph_json(b) == '{\n  "concepts": [\n    {\n      "id": "source",\n      "links": [\n        {\n          "target": "target",\n          "exists": true,\n          "text": "a \\"quote\\"",\n          "raw": "target.md#x\\"y"\n        }\n      ],\n      "sources": []\n    },\n    {\n      "id": "target",\n      "links": [],\n      "sources": []\n    }\n  ]\n}\n'


@pytest.mark.parametrize(("text", "shown"), [("a (§5.1)", "a"), ("read as v0.2 under the §13.1 fallbacks", "read as v0.2 under the fallbacks"), ("a (§5.1, §6 to §7.2) b", "a b"), ("keep (this) §", "keep (this) §")])
def test_without_sections(text, shown):
    assert render.without_sections(text) == shown


def test_link_kinds_and_paths(spark):
    targets = ["/tables/users.md", "./other.md", "../sibling.md", "https://example.com", "mailto:a@b.com", "#section", "//cdn.example.com/x.js", "bigquery:acme.sales.orders", "./notes/a:b.md", "2026:notes.md", "", " "]
    d = spark.createDataFrame([(t,) for t in targets], "t string")
    assert [r[0] for r in d.select(c.link_kind(F.col("t"))).collect()] == ["absolute", "relative", "relative", "external", "external", "anchor", "external", "external", "relative", "relative", "other", "other"]
    src = F.array(F.lit("tables"), F.lit("orders"))
    ids = [r[0] for r in d.select(F.array_join(c.link_ids(c.without_anchor(F.col("t")), c.link_kind(F.col("t")), src), "/")).collect()]
    assert ids == ["tables/users", "tables/other", "sibling", None, None, None, None, None, "tables/notes/a:b", "tables/2026:notes.md".removesuffix(".md"), None, None]
    cases = [("references/skills/run.md", ["computations/references/skills/run.md", "references/skills/run.md"]), ("/a/../b.md", ["b.md"]), ("../../x", []), ("https://x", []), ("../x.md#a", ["x.md"])]
    got = spark.createDataFrame([(x,) for x, _ in cases], "t string").select(c.field_paths(F.col("t"), F.array(F.lit("computations"), F.lit("revenue")))).collect()
    assert [r[0] for r in got] == [w for _, w in cases]


def test_small_columns(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    actors = {"reference_agent/gemini-2.5-pro": "agent", "human:ahormati": "human", "process:finance-nightly": "process", "team:ga4-docs": "other", "human:": "other", "a/b/c": "other", "team:x/y": "agent"}
    assert {a: one(c.actor_kind(F.lit(a))) for a in actors} == actors
    assert one(c.percent_encoded(F.lit("a b/*~é+.md"))) == "a%20b/%2A~%C3%A9%2B.md" and one(c.percent_encoded(F.lit(""))) == ""
    assert one(c.markdown_escaped(F.lit("a[b]\\<c>&d\n"))) == "a\\[b\\]\\\\\\<c\\>\\&d "
    assert one(c.quoted(F.lit('a"b\\\n'))) == '"a\\"b\\\\\\n"'
    assert [one(c.resource_kind(F.lit(x))) for x in ("", "https://x", "mailto:a", "all of it", "bigquery:a.b", None)] == ["missing", "url", "url", "scope", "path", "missing"]
    assert [one(c.names_concept(F.lit(x))) for x in ("a.md", "a", "a.png", "#x", "http://x/a.md", "d/", "a.b/c")] == [True, True, False, False, False, True, True]


def test_awkward_names_and_order(spark):
    files = {"tables/my notes.md": "---\ntype: A\n---\n", "tables/rocket🚀.md": "---\ntype: A\n---\n", "tables/orders.md": "---\ntype: A\n---\n[a](my notes.md) [b](<my notes.md>) [c](/tables/my%20notes.md) [d](rocket%F0%9F%9A%80.md) [up](../../x.md) [dir](sub/)\n", "a.md": "---\ntype: A\n---\n", "a/b.md": "---\ntype: A\n---\n", "a-b.md": "---\ntype: A\n---\n", ".h/x.md": "---\ntype: A\n---\n", "X.MD": "no", "_y.md": "---\ntype: A\n---\n"}
    b = Bundle(from_rows(spark, files.items()))
    assert [(r.target_id, r.exists) for r in b.links.orderBy("seq").collect()] == [("tables/my notes", True)] * 3 + [("tables/rocket🚀", True)]
    assert [r.id for r in b.concepts.where("not id like 'tables%'").orderBy("path_segs").select("id").collect()] == [".h/x", "_y", "a/b", "a-b", "a"]
    assert [r.id for r in b.concepts.where("id like 'a%'").orderBy("id_segs").select("id").collect()] == ["a", "a/b", "a-b"]


def test_first_key_wins_and_orders(spark):
    b = Bundle(from_rows(spark, [("a.md", "---\nextra: 1\ntitle: A\ntitle: B\n42: x\ntags: [t]\ntype: T\ntimestamp: x\n---\n")]))
    r = b.concepts.first()
    assert r.title == "A" and r.extension_keys == ["extra"] and r.legacy_keys == ["timestamp"]
    from loomwright.operators.concepts import reordered

    assert reordered(b.concepts).first()["keys"] == ["type", "title", "title", "tags", "extra", "42", "timestamp"]


def test_indexes(spark):
    files = {
        "index.md": "---\nokf_version: '0.2'\nother: 1\n---\nold\n", "datasets/ga4.md": "---\ntype: Dataset\ntitle: GA4 [x]\ndescription: About it\n---\n",
        "tables/events_.md": "---\ntype: BigQuery Table\ntitle: ''\n---\n", "tables/users.md": "---\ntype: BigQuery Table\ntitle: apple\ndescription: d1\n---\n", "tables/log.md": "# L\n", "tables/deep/er/x y.md": "---\ntype: T\n---\n", "pics/a.png": "", "bad.md": "---\n",
    }
    b = Bundle(from_rows(spark, files.items()))
    got = {r.rel_path: r.content for r in b.index_texts().collect()}
    assert got["datasets/index.md"] == "# Dataset\n\n* [GA4 \\[x\\]](ga4.md) - About it\n"
    assert got["tables/index.md"] == "# BigQuery Table\n\n* [apple](users.md) - d1\n* [events_](events_.md)\n\n# Other\n\n* [log](log.md)\n\n# Subdirectories\n\n* [deep](deep/index.md) - Contains 1 entries: er.\n".replace("Contains 1 entries: er.", "Contains 1 entries: x y.")
    assert got["tables/deep/er/index.md"] == "# T\n\n* [x y](x%20y.md)\n"
    assert got["index.md"].startswith("---\nokf_version: \"0.2\"\n---\n\n# Subdirectories\n\n* [datasets](datasets/index.md) - About it\n* [pics](pics/index.md)\n* [tables](tables/index.md) - Contains 4 entries: ")
    own = {r.rel_path: r.content for r in b.index_texts(lambda titles, _, n: F.concat(F.lit("n="), n.cast("string"))).collect()}
    assert "(tables/index.md) - n=4" in own["index.md"]
    assert indexes.index_text([("", "b", "b.md", ""), ("", "A", "a b.md", "x")]) == "# Other\n\n* [A](a%20b.md) - x\n* [b](b.md)\n"


def test_diff(spark):
    base = {"a.md": "---\ntype: T\ntitle: A\nn: .nan\n---\none [b](b.md) [x](gone.md)\n", "b.md": "---\ntype: T\ntitle: B\n---\nbody\n", "c.md": "---\ntype: T\ntitle: C\n---\n[b](b.md)\n", "d1.md": "---\ntype: T\n---\nsame\n", "d2.md": "---\ntype: T\n---\nsame\n"}
    later = {"a.md": "---\ntype: T\ntitle: A2\nn: .nan\nstatus: draft\nverified: { by: human:x, at: 2026-01-01T00:00:00Z }\n---\ntwo [b](b.md) [y](nope.md)\n", "b.md": base["b.md"], "e1.md": base["d1.md"], "e2.md": base["d2.md"], "new.md": "---\ntype: T\n---\n[a](a.md)\n"}
    a, b = Bundle(from_rows(spark, base.items())), Bundle(from_rows(spark, later.items()))
    assert diff.rendered(a.diff(b)) == (
        "added (1):\n  + new\nremoved (1):\n  - c\nrenamed (2):\n  ~ d1 -> e1\n  ~ d2 -> e2\ncontent (1):\n  ~ a (body)\nfrontmatter (1):\n  a:\n    + status\n    + verified\n    ~ n: .nan -> .nan\n    ~ title: A -> A2\n"
        "trust (1):\n  a: tier unverified -> human-reviewed status stable -> draft\nadded links (1):\n  + new -> a\nremoved links (1):\n  - c -> b\nmended links (1):\n  + a -> gone.md\nbroken links (1):\n  - a -> nope.md\n"
    )
    assert sum(r.changes for r in diff.size(a.diff(b)).collect()) == 11
    assert diff.rendered(b.diff(b).where("kind <> 'changed'")) == "no changes\n"
    back = a.diff(b, ("added", "removed")), b.diff(a, ("added", "removed"))
    assert {r.id for r in back[0].where("section = 'added'").collect()} == {r.id for r in back[1].where("section = 'removed'").collect()}


def write(root, files):
    for p, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, p)), exist_ok=True)
        with open(os.path.join(root, p), "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def test_sources(spark, tmp_path):
    write(tmp_path, FINANCE | {"_h/.x.md": "---\ntype: A\n---\n", ".git/y.md": "---\ntype: A\n---\n"})
    os.symlink(tmp_path / "metrics", tmp_path / "linked")
    assert len(listed(str(tmp_path))) == len(FINANCE) + 2
    tree = read_tree(spark, str(tmp_path))
    assert {r.rel_path for r in tree.collect()} == set(FINANCE) | {"_h/.x.md", ".git/y.md"}
    assert {r.id for r in Bundle(tree).concepts.select("id").collect()} >= {"_h/.x", ".git/y", "computations/profit"}
    os.unlink(tmp_path / "linked")
    assert {r.rel_path for r in read_lake(spark, str(tmp_path)).collect()} == set(FINANCE)
    with pytest.raises(NotABundle):
        read_tree(spark, str(tmp_path / "none"))


def test_bad_utf8(spark):
    rows = [("a.md", b"\xff"), ("index.md", b"\xff"), ("log.md", b"\xff")]
    with pytest.raises(UnreadableConcept):
        _ = Bundle(from_rows(spark, rows), strict=True).rows
    assert [r.message.split(":")[0] for r in Bundle(from_rows(spark, rows[1:])).validate().orderBy("phase").collect()] == ["unreadable reserved index.md", "unreadable reserved log.md"]


def test_save_and_repartition(spark, finance, tmp_path):
    finance.save(str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "links")).count() == 5
    again = Bundle(from_rows(spark, FINANCE.items()).repartition(7))
    key = lambda b: sorted((r.code, r.concept or "", r.message) for r in b.validate("2026-07-01").collect())
    assert key(again) == key(finance)


def test_streams(spark, tmp_path):
    rows = [("main", "a.md", b"---\ntype: T\n---\n", "2026-01-01 00:01:00"), ("main", "b.md", b"none", "2026-01-01 00:02:00"), ("main", "log.md", b"## 2026-01-01\n* a\n- b\n", "2026-01-01 00:03:00")]
    first = spark.createDataFrame(rows, "bundle string, rel_path string, content binary, t string").select("bundle", "rel_path", "content", F.to_timestamp("t").alias("arrived"))
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = snapshots.file_stream(spark, str(tmp_path / "in"), 1)
    for make, name in ((snapshots.concept_types, "types"), (snapshots.log_counts, "logs")):
        q = make(stream).writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert {r.type: r.n for r in spark.table("types").collect()} == {"T": 1, "(none)": 2}
    assert spark.table("logs").first().n_bullets == 2
    first.where("rel_path <> 'b.md'").withColumn("content", F.concat("content", F.lit(b"more"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    q = snapshots.snapshot_changes(spark, stream, str(tmp_path / "state"), lambda d, n: seen.append({(r.section, r.id) for r in d.collect()}), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 1 and ({("content", "a"), ("removed", "b")} == seen[0] or {("content", "a"), ("added", "b")} == seen[0])
