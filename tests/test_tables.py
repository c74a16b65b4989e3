"""Saved tables: links without moving rows, and refreshes that parse what changed."""

from loomwright.plans import tables
from loomwright.plans.bundle import Bundle
from loomwright.sources.bundle import from_rows


def note(*targets):
    return "---\ntype: Note\n---\n\n" + " ".join(f"[x]({t})" for t in targets) + "\n"


def rows(df):
    return sorted((r.src_id, r.seq, r.target_id, r.exists, r.raw) for r in df.collect())


FILES = {"a.md": note("b.md", "gone.md", "my%20note.md"), "b.md": note("a.md"), "my note.md": note(), "d/c.md": note("../a.md"), "broken.md": "---\ntype: N\n", "x.csv": b"1"}


def test_links_of_saved_tables(spark, tmp_path):
    bundle = Bundle(from_rows(spark, FILES.items()))
    tables.save(bundle, str(tmp_path / "t"), 4)
    loaded = tables.BundleTables(spark, str(tmp_path / "t"), 4)
    assert rows(loaded.links()) == rows(bundle.links) and len(rows(bundle.links)) == 5
    known = loaded.ids
    plain = loaded.plain_links
    plan = plain.join(known.hint("merge"), (plain["bundle"] == known["bundle"]) & (plain["target_id"] == known["id"]), "left")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_a_refresh_parses_what_changed(spark, tmp_path):
    saved = tables.save(Bundle(from_rows(spark, FILES.items())), str(tmp_path / "t"), 4)
    later = {k: v for k, v in FILES.items() if k != "b.md"} | {"a.md": note("new.md"), "new.md": note("a.md")}
    files = from_rows(spark, later.items())
    assert sorted(r.rel_path for r in saved.changed(files).where("rel_path like '%.md'").collect()) == ["a.md", "new.md"]
    made = saved.refreshed(files, str(tmp_path / "u"))
    whole = Bundle(files)
    assert rows(made.links()) == rows(whole.links)
    assert sorted((r.rel_path, r.error, r.serialized) for r in made.rows.collect()) == sorted((r.rel_path, r.error, r.serialized) for r in whole.rows.collect())
    same = made.refreshed(files, str(tmp_path / "v"))
    assert made.changed(files).where("rel_path like '%.md'").isEmpty() and same.rows.count() == made.rows.count()
