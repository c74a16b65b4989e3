"""Reports read the columns they need of what was parsed once, and work out each link once."""

from loomwright.operators import graph, logs
from loomwright.plans import tables
from loomwright.plans.bundle import Bundle
from loomwright.sources.bundle import from_rows

FILES = [("a.md", "---\ntype: Note\ntitle: A\n---\n\n[b](d/b%20c.md#x) [up](../gone.md) [n](/d/b.md)\n"), ("d/b.md", "---\ntype: Note\n---\n\n[a](../a.md)"), ("d/b c.md", "x")]


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_link_readings_are_worked_out_once(spark):
    bundle = Bundle(from_rows(spark, FILES))
    raw = graph.raw_links(bundle.concepts).select("src_id", "seq", "candidates")
    # one walk over the steps of a target for its plain reading and one for its decoded reading
    assert raw._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2
    assert {(r.src_id, r.seq): ["/".join(c) for c in r.candidates] for r in raw.collect()} == {("a", 0): ["d/b%20c", "d/b c"], ("a", 1): [], ("a", 2): ["d/b"], ("d/b", 0): ["a"]}
    assert {(r.src_id, r.target_id, r.exists) for r in bundle.links.collect()} == {("a", "d/b c", True), ("a", "d/b", True), ("d/b", "a", True)}
    bundle.release()


def test_reports_read_no_texts_they_do_not_show(spark, tmp_path):
    bundle = Bundle(from_rows(spark, FILES))
    shown = plan(bundle.concepts.select("id", "title"))
    assert "InMemoryRelation" not in shown and "ReadSchema" in shown and "body" not in shown.split("ReadSchema")[-1]
    assert {r.id: r.serialized for r in bundle.concepts.select("id", "serialized").collect()}["d/b"] == "---\ntype: Note\n---\n\n[a](../a.md)\n"
    # rows keep the digest of their content, so that saving them joins nothing
    saved = tables.save(bundle, f"{tmp_path}/saved")
    assert saved.changed(from_rows(spark, [*FILES[:2], ("d/b c.md", "y")])).count() == 1
    assert "digest" in bundle.rows.columns
    bundle.release()


def test_lines_of_logs_are_cut_once(spark):
    bundle = Bundle(from_rows(spark, [("log.md", "# T\r\n\n## 2026-01-02\n* **New**: a \n  b\n# U\n## soon\n\r")]))
    for made in (logs.problems(bundle.logs), logs.to_markdown(bundle.logs)):
        assert "split(" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.message for r in logs.problems(bundle.logs).collect()) == ['log contains non-log content at line 6', 'log date group "soon" has no entries', 'log date heading is not ISO-8601 `YYYY-MM-DD`: "soon"']
    assert [(r.no, r.kind, r.rest, r.line) for r in logs.lines(bundle.logs).orderBy("no").collect()][-2:] == [(7, "date", "soon", "## soon"), (8, "blank", None, "")]
    bundle.release()
