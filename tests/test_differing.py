"""Reports on two snapshots parse the files that differ, and tell what parsing all of them tells."""

from loomwright.plans.bundle import Bundle
from loomwright.sources.bundle import from_rows

SECTIONS = ("added", "removed", "renamed", "content", "frontmatter", "trust")
BEFORE = {
    "same.md": "---\ntype: N\n---\nsame\n", "odd.md": "---\ntype: N\nscore: .NaN\n---\nodd\n", "gone.md": "---\ntype: N\n---\ngone\n", "old/name.md": "---\ntype: N\n---\nmoved\n",
    "text.md": "---\ntype: N\n---\nbefore\n", "keys.md": "---\ntype: N\n---\nkeys\n", "broken.md": "---\ntype: N\n", "mended.md": "---\ntype: N\n", "spoilt.md": "---\ntype: N\n---\nx\n", "index.md": "# A\n", "a.png": b"1",
}
AFTER = {k: v for k, v in BEFORE.items() if k not in ("gone.md", "old/name.md")} | {
    "new/name.md": "---\ntype: N\n---\nmoved\n", "text.md": "---\ntype: N\n---\nafter\n", "keys.md": "---\ntype: N\nstatus: draft\n---\nkeys\n", "mended.md": "---\ntype: M\n---\n", "spoilt.md": "---\ntype: N\n",
    "come.md": "---\ntype: N\n---\nnew\n", "index.md": "# B\n", "a.png": b"2",
}


def rows(df):
    return sorted(map(str, df.collect()))


def test_only_files_that_differ_are_parsed(spark):
    a, b = (Bundle(from_rows(spark, files.items())) for files in (BEFORE, AFTER))
    found = rows(a.diff(b, SECTIONS))
    assert "rows" not in a.__dict__ and "rows" not in b.__dict__
    assert {r.rel_path for side in a._differing(b) for r in side.collect()} == {p for p in (*BEFORE, *AFTER) if p.endswith(".md")} - {"same.md", "broken.md"}
    whole = [Bundle(from_rows(spark, files.items())) for files in (BEFORE, AFTER)]
    for one in whole:
        one.rows.count()
    assert found == rows(whole[0].diff(whole[1], SECTIONS)) and len(found) == 9
    assert rows(a.diff(b, ("added", "renamed"))) == rows(whole[0].diff(whole[1], ("added", "renamed")))


def test_findings_of_one_rule_resolve_no_links(spark):
    one = Bundle(from_rows(spark, [("a.md", "---\ntype: N\n---\n\n[b](b.md)\n"), ("b.md", "---\ntype: N\n---\n")]))
    found = rows(one.lint(None, ("L7", "L8")))
    assert "links" not in one.__dict__
    assert found == rows(one.lint().where("code in ('L7', 'L8')")) and len(found) == 2
    assert rows(one.lint(None, ("L13", "L15"))) == rows(one.lint().where("code in ('L13', 'L15')")) and len(found) == 2
