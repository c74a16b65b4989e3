"""Edited frontmatter against hand-written documents, strict reading, and renames among very many equal contents."""

import pytest
from pyspark.sql import functions as F

from loomwright.operators import diff, edits, strict
from loomwright.plans.bundle import Bundle
from loomwright.sources.bundle import from_rows

DOC = "---\ntype: Note\ntitle: One\ntags: [a, b]\n1: number key\ntitle: Two\nsources:\n- id: s\n  resource: a.md\nempty: {}\n---\n\nBody.\n"


def edited(spark, change, content=DOC):
    rows = Bundle(from_rows(spark, [("x.md", content)])).rows
    return rows.select(edits.document(change(edits.entries())).alias("d"), "serialized").first()


def front(*lines):
    return "---\n" + "\n".join(lines) + "\n---\n\nBody.\n"


KEPT = ("tags:\n  - a\n  - b", "1: number key", "title: Two", "sources:\n  - id: s\n    resource: a.md", "empty: {}")


def test_unchanged_documents_are_those_of_the_normal_form(spark):
    for content in (DOC, "No frontmatter.", "---\n---\nBody", "---\n'a: b': x\n\"[k]\": [1, [2, 3], {q: r}]\nt: |\n  two\n  lines\n---\n\nB"):
        row = edited(spark, lambda e: e, content)
        assert row.d == row.serialized


@pytest.mark.parametrize(
    ("change", "lines"),
    [
        (lambda e: edits.set_value(e, "title", edits.value_of(F.lit("New: it"))), ("type: Note", 'title: "New: it"', *KEPT)),
        (lambda e: edits.set_value(e, "added", edits.value_of(F.array(F.lit("p"), F.lit("true"), F.lit("")))), ("type: Note", "title: One", *KEPT, 'added:\n  - p\n  - "true"\n  - ""')),
        (lambda e: edits.set_value(e, "n", edits.value_of(F.lit(3))), ("type: Note", "title: One", *KEPT, "n: 3")),
        (lambda e: edits.set_value(e, "tags", edits.value_of(F.array().cast("array<string>"))), ("type: Note", "title: One", "tags: []", *KEPT[1:])),
        (lambda e: edits.set_value(e, "none", edits.value_of(F.lit(None).cast("string"))), ("type: Note", "title: One", *KEPT, "none: null")),
        (lambda e: edits.remove(e, "title"), ("type: Note", *KEPT)),
        (lambda e: edits.remove(edits.remove(e, "title"), "title"), ("type: Note", *KEPT[:2], *KEPT[3:])),
        (lambda e: edits.remove(e, "1"), ("type: Note", "title: One", *KEPT)),
        (lambda e: edits.remove(e, "gone"), ("type: Note", "title: One", *KEPT)),
        (lambda e: edits.rename(e, "type", "a: key"), ('"a: key": Note', "title: One", *KEPT)),
        (lambda e: edits.rename(e, "gone", "x"), ("type: Note", "title: One", *KEPT)),
        (lambda e: edits.set_value(edits.remove(e, "type"), "type", edits.value_of(F.lit("Last"))), ("title: One", *KEPT, "type: Last")),
    ],
)
def test_changes(spark, change, lines):
    assert edited(spark, change).d == front(*lines)


def test_reading_entries(spark):
    row = Bundle(from_rows(spark, [("x.md", DOC)])).rows.select(edits.keys(edits.entries()).alias("k"), edits.get(edits.entries(), "title").alias("t"), edits.get(edits.entries(), "gone").alias("g"), edits.contains(edits.entries(), "1").alias("c")).first()
    assert row.k == ["type", "title", "tags", "title", "sources", "empty"] and (row.t, row.g, row.c) == ("One", None, False)


@pytest.mark.parametrize(
    ("content", "message"),
    [
        ("---\ntype: Note\n", "x.md: Unterminated YAML frontmatter block"), ("---\n- a\n---\n", "x.md: Frontmatter must be a YAML mapping"), ("---\na:\n\t- b\n---\n", "x.md: Invalid YAML in frontmatter: YAML error at line 2"),
        ("---\ntitle: a\n---\n", "x.md: Missing required frontmatter keys: type"), ("---\ntype: [a]\n---\n", "x.md: Missing required frontmatter keys: type"), (b"\xff", "x.md: stream did not contain valid UTF-8"),
    ],
)
def test_strict_reading_ends_with_the_file_and_its_error(spark, content, message):
    bundle = Bundle(from_rows(spark, [("ok.md", "---\ntype: A\n---\n"), ("x.md", content)]))
    with pytest.raises(Exception, match=message.replace(":", ".")):
        bundle.valid_concepts.select("id").collect()
    assert [r.id for r in Bundle(from_rows(spark, [("ok.md", "---\ntype: A\n---\n")])).valid_concepts.select("id").collect()] == ["ok"]


def test_strict_values(spark):
    d = spark.createDataFrame([("2026-01-02", 1), (None, None)], "t string, p int")
    assert [r.p for r in d.select(strict.moment_or_fail("t", "p").alias("p")).collect()] == [1, None]
    with pytest.raises(Exception, match="not an ISO-8601 date/datetime. .soon"):
        spark.createDataFrame([("soon", None)], "t string, p int").select(strict.moment_or_fail("t", "p")).collect()
    assert spark.range(1).select(strict.id_or_fail(F.array(F.lit("a"), F.lit("b"))).alias("i")).first().i == ["a", "b"]
    with pytest.raises(Exception, match="invalid concept id"):
        spark.range(1).select(strict.id_or_fail(F.array(F.lit("a"), F.lit("..")))).collect()


def test_renames_among_many_equal_contents(spark):
    n = 20_000
    met = spark.range(2 * n).select(F.lit("b").alias("bundle"), F.when(F.col("id") < n, F.concat(F.lit("old"), F.lpad(F.col("id").cast("string"), 6, "0"))).otherwise(F.concat(F.lit("new"), F.lpad((F.col("id") - n).cast("string"), 6, "0"))).alias("id"))
    old = F.col("id").startswith("old")
    met = met.select("bundle", "id", F.when(old, F.array("id")).alias("a_segs"), F.when(old, "same").alias("a_content"), F.when(~old, F.array("id")).alias("b_segs"), F.when(~old, "same").alias("b_content")).repartition(7)
    pairs = diff.renames(met)
    assert pairs.where("substring(id, 4) = substring(old_id, 4)").count() == pairs.count() == n
