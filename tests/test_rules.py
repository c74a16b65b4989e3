"""Conformance and health rules: many small bundles, validated and linted in one job."""

import pytest

from loomwright.operators import validate
from loomwright.plans.bundle import Bundle
from loomwright.sources.bundle import from_rows

GOOD = "---\ntype: Metric\ntitle: {t}\ndescription: d\ngenerated: {{ by: writer/1, at: 2026-05-01T00:00:00Z }}\nverified: {{ by: human:x, at: 2026-06-01T00:00:00Z }}\n{more}---\n\n# H\n{body}\n"
INDEX = "# All\n\n* [m](m.md)\n"


def good(more="", body="text", t="T"):
    return GOOD.format(more=more + ("\n" if more else ""), body=body, t=t)


#: name: (files, expected validate messages, expected lint codes); an expected message is "severity code part-of-text".
CASES = {
    "clean": ({"m.md": good(), "index.md": INDEX}, [], []),
    "no_type": ({"m.md": good().replace("type: Metric\n", ""), "index.md": INDEX}, ["error V2 missing required"], []),
    "list_type": ({"m.md": good().replace("Metric", "[a, b]"), "index.md": INDEX}, ["error V2 non-empty scalar"], []),
    "zero_type": ({"m.md": good().replace("Metric", "0"), "index.md": INDEX}, ["error V2 missing required"], []),
    "false_type": ({"m.md": good().replace("Metric", "false"), "index.md": INDEX}, ["error V2 missing required"], []),
    "zero_float_type": ({"m.md": good().replace("Metric", "0.0"), "index.md": INDEX}, [], []),
    "blank_type": ({"m.md": good().replace("Metric", '"  "'), "index.md": INDEX}, [], []),
    "bare": ({"m.md": "---\ntype: X\n---\n", "index.md": INDEX}, ["warning V3 `title`", "warning V3 `description`", "warning V3 `generated`"], ["L1", "L2", "L3", "L4", "L7"]),
    "empty_title": ({"m.md": good().replace("title: T", "title: ''"), "index.md": INDEX}, ["warning V3 `title`"], []),
    "bad_tags": ({"m.md": good("tags: a, b"), "index.md": INDEX}, ["warning V4 found a string"], []),
    "bad_generated": ({"m.md": good().replace("{ by: writer/1, at: 2026-05-01T00:00:00Z }", "someone"), "index.md": INDEX}, ["warning V5 found a string"], []),
    "generated_parts": ({"m.md": good().replace("{ by: writer/1, at: 2026-05-01T00:00:00Z }", "{ at: 2026-05-01 }"), "index.md": INDEX}, ["warning V5 `generated.by`", 'warning V5 datetime: "2026-05-01"'], []),
    "bad_verified": ({"m.md": good().replace("{ by: human:x, at: 2026-06-01T00:00:00Z }", "yes"), "index.md": INDEX}, ["warning V6 found a string"], []),
    "verified_items": ({"m.md": good().replace("{ by: human:x, at: 2026-06-01T00:00:00Z }", "[ done, { by: '', at: yesterday }, { by: x } ]"), "index.md": INDEX}, ["warning V6 `verified[0]` should be a mapping", "warning V6 `verified[1].by` is missing", 'warning V6 `verified[1].at` is not an ISO-8601 datetime: "yesterday"', "warning V6 `verified[2].at` is missing"], []),
    "no_events": ({"m.md": good().replace("{ by: human:x, at: 2026-06-01T00:00:00Z }", "[ done ]"), "index.md": INDEX}, ["warning V6 contains no", "warning V6 `verified[0]`"], []),
    "status": ({"m.md": good("status: experimental"), "index.md": INDEX}, ['warning V7 unknown `status` value "experimental"'], []),
    "draft": ({"m.md": good("status: draft"), "index.md": INDEX}, [], ["L12"]),
    "stale": ({"m.md": good("stale_after: 2026-06-15"), "index.md": INDEX}, ["info V8 stale since 2026-06-15"], ["L11"]),
    "stale_datetime": ({"m.md": good("stale_after: '2026-06-15T00:00:00Z'"), "index.md": INDEX}, ["warning V8 not an absolute"], ["L11"]),
    "stale_garbage": ({"m.md": good("stale_after: soon"), "index.md": INDEX}, ['warning V8 date: "soon"'], []),
    "window_alone": ({"m.md": good("usage_window: { from: 2026-01-01 }"), "index.md": INDEX}, ["warning V9 without `sources`"], []),
    "sources_shape": ({"m.md": good("sources: none"), "index.md": INDEX}, ["warning V9 found a string"], []),
    "sources": (
        {"m.md": good("usage_window: { from: bad, to: 2026-01-01 }\nsources:\n- plain\n- id: a\n  resource: https://x/y\n- id: a\n  usage_count: many\n  last_modified: never"), "index.md": INDEX},
        ['warning V9 `usage_window.from` is not a `YYYY-MM-DD` date: "bad"', "warning V10 `sources[0]` should be a mapping", "warning V10 `sources[2].resource` is required", 'warning V10 duplicate `sources[].id` "a"', "warning V10 `sources[2].last_modified`", "warning V10 `sources[2].usage_count` should be an integer, found a string"],
        [],
    ),
    "count_without_window": ({"m.md": good("sources:\n- { resource: https://x/y, usage_count: 3 }"), "index.md": INDEX}, ["warning V10 `sources[0].usage_count` has no"], []),
    "bare_source": ({"m.md": good("sources: { id: s, resource: https://x/y }", "a[^s]\n\n[^s]: b"), "index.md": INDEX}, [], []),
    "footnotes": ({"m.md": good("sources: [{ id: s, resource: https://x/y }]", "a[^q] b[^s]\n\n[^s]: b"), "index.md": INDEX}, ["warning V11 [^q] matches no", "warning V11 [^q] is cited but never defined"], []),
    "legacy": ({"m.md": good("timestamp: 2026-01-01T00:00:00Z", "# Citations\n[1] [a](http://x)"), "index.md": INDEX}, ["warning V12 redundant alongside", "warning V12 `# Citations`"], ["L5", "L6"]),
    "stray_contract": ({"m.md": good("runtime: sql\nexecutor: { resource: https://x/run }"), "index.md": INDEX}, ["info V13 `runtime`, `executor`"], []),
    "contract": (
        {"m.md": good("parameters: [{ type: int }, { name: y }]\nexecutor: {}").replace("Metric", "Attested Computation"), "index.md": INDEX},
        ["warning V14 `runtime` is required", "warning V14 no computation", "warning V14 `parameters[0].name`", "warning V14 `parameters[1].type`", "warning V14 `executor.resource` is missing", "warning V14 `executor.receipt` is empty", "warning V14 missing `attester`"],
        [],
    ),
    "contract_both": ({"m.md": good("runtime: sql\ncomputation: q.sql\nexecutor: { resource: r.md, receipt: log }\nattester: { resource: /c.py }", "# Computation\n\n    SELECT 1").replace("Metric", "Attested Computation"), "q.sql": "", "r.md": good(t="R"), "c.py": "", "index.md": INDEX + "* [r](r.md)\n"}, ["warning V14 one or the other"], []),
    "paths": ({"m.md": good("resource: /gone.py"), "x.md": good("resource: bare.py", t="X"), "index.md": INDEX + "* [x](x.md)\n"}, ["info V15 `resource` does not resolve to a file in the bundle: /gone.py"], []),
    "segments": ({"my dir/a.md": good(t="A"), "my dir/b.md": good(t="B"), "index.md": "# A\n* [a](my%20dir/a.md) [b](<my dir/b.md>)\n"}, ['warning V16 "my dir"'], []),
    "indexes": ({"m.md": good(), "index.md": "---\nokf_version: '0.2'\nextra: 1\n---\n" + INDEX, "d/index.md": "---\na: 1\n---\n# X\n", "e/index.md": "---\nopen\n"}, ["error V17 only `okf_version`", "error V17 should not contain", "error V17 unparseable"], []),
    "versions": ({"m.md": good(), "index.md": "---\nokf_version: '0.9'\n---\n" + INDEX}, ["info V19 unrecognized `okf_version: 0.9`"], []),
    "unquoted_version": ({"m.md": good(), "index.md": "---\nokf_version: 0.9\n---\n" + INDEX}, [], []),
    "broken": ({"m.md": good(body="[a](/no/where.md) [i](sub/index.md) ![p](p.png)"), "sub/index.md": "# S\n", "index.md": INDEX}, ["info V20 /no/where.md", "info V20 sub/index.md", "info V20 p.png"], []),
    "unparsed": ({"m.md": good(), "bad.md": "---\na: [\n---\n", "bad2.md": "---\n- a\n---\n", "bad3.md": "---\n", "index.md": INDEX}, ["error V1 Invalid YAML in frontmatter: YAML error at line 1", "error V1 must be a YAML mapping", "error V1 Unterminated"], []),
    "logs": (
        {"m.md": good(), "log.md": "# L\n\n* early\n## 2026-01-01\n* **New**: x\n  continued\n\n## 2026-02-01\n## soon\n- y\nstray\n# again\n", "x/log.md": "nothing\n", "index.md": INDEX},
        ["error V18 outside a date group at line 3", 'error V18 "2026-02-01" has no entries', 'error V18 not newest first: "2026-02-01" follows "2026-01-01"', "error V18 non-log content at line 11", "error V18 non-log content at line 12", 'error V18 `YYYY-MM-DD`: "soon"', "error V18 contains no date groups", "error V18 non-log content at line 1"],
        [],
    ),
    "reversed_trust": ({"m.md": good().replace("2026-06-01", "2026-04-01"), "index.md": INDEX}, [], ["L9"]),
    "no_heading": ({"m.md": good().replace("# H\n", ""), "index.md": INDEX}, [], ["L8"]),
    "deprecated": ({"m.md": good(body="[o](old.md) [again](old.md)"), "old.md": good("status: deprecated", t="O"), "index.md": INDEX + "* [o](old.md)\n"}, [], ["L10"]),
    "selfish": ({"m.md": good(body="[me](m.md) [me](/m.md)")}, [], ["L13"]),
    "twins": ({"m.md": good(), "n.md": good(), "index.md": INDEX + "* [n](n.md)\n"}, [], ["L14", "L14"]),
    "orphan": ({"m.md": good(), "n.md": good(t="N"), "index.md": INDEX + "* [gone](gone.md) [pic](p.png)\n"}, [], ["L15", "L16"]),
}


@pytest.fixture(scope="module")
def reports(spark):
    rows = None
    for name, (files, _, _) in CASES.items():
        own = [(name, p, c.encode()) for p, c in files.items()]
        rows = (rows or []) + own
    bundle = Bundle(spark.createDataFrame(rows, "bundle string, rel_path string, content binary"))
    found = validate.in_order(bundle.validate("2026-07-01")).collect()
    health = validate.in_order(bundle.lint("2026-07-01")).collect()
    bundle.release()
    return found, health


@pytest.mark.parametrize("name", CASES)
def test_validate(reports, name):
    got = [r for r in reports[0] if r.bundle == name]
    want = CASES[name][1]
    said = [f"{r.severity} {r.code} {r.message}" for r in got]
    assert len(said) == len(want), said
    for w in want:
        head, part = " ".join(w.split()[:2]), " ".join(w.split()[2:])
        assert any(s.startswith(head) and part in s for s in said), (w, said)


@pytest.mark.parametrize("name", CASES)
def test_lint(reports, name):
    # these are about other rules, and their files are in no index or have equal titles by design
    beside = ("L14", "L15", "L16") if name in ("indexes", "unparsed", "contract_both") else ()
    assert sorted(r.code for r in reports[1] if r.bundle == name and r.code not in beside) == sorted(CASES[name][2])


def test_order_of_reports(reports):
    phases = [r.phase for r in reports[0] if r.bundle == "logs"]
    assert phases == sorted(phases)
    assert [r.code for r in reports[0] if r.bundle == "verified_items"] == ["V6"] * 4


def test_without_a_date_nothing_is_stale(spark):
    bundle = Bundle(from_rows(spark, CASES["stale"][0].items()))
    assert bundle.validate().count() == 0
    assert bundle.lint().where("code = 'L11'").count() == 0
    bundle.release()


def test_totals_of_bundles_without_findings(spark):
    found = spark.createDataFrame([("a", "error"), ("a", "info"), ("b", "warning")], "bundle string, severity string")
    bundles = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "bundle string")
    assert {tuple(r) for r in validate.totals(found, bundles).collect()} == {("a", 1, 0, 1, False), ("b", 0, 1, 0, True), ("c", 0, 0, 0, True)}
    assert validate.totals(found).count() == 2
