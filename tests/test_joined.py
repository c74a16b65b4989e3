"""One text file from ordered rows."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomwright.plans import render
from loomwright.plans.bundle import Bundle
from loomwright.sources.bundle import from_rows
from loomwright.sources.joined import write_joined


def test_rows_of_many_tasks_stand_in_order(spark, tmp_path):
    rows = spark.range(5000).repartition(9).select("id", F.concat(F.lit("é"), "id").alias("t"))
    path = str(tmp_path / "out" / "all.txt")
    write_joined(rows, "t", F.desc("id"), path=path, head="[", between=",\n", tail="]\n")
    assert open(path, encoding="utf-8").read() == "[" + ",\n".join(f"é{i}" for i in reversed(range(5000))) + "]\n"
    assert os.listdir(tmp_path / "out") == ["all.txt"]
    write_joined(rows.where("false"), "t", "id", path=path, head="[", between=",", tail="]")
    assert open(path).read() == "[]"


def test_a_write_that_fails_leaves_the_file(spark, tmp_path):
    path = str(tmp_path / "all.txt")
    (tmp_path / "all.txt").write_text("old")
    bad = spark.range(100).select("id", F.when(F.col("id") == 60, F.raise_error(F.lit("no"))).otherwise("x").alias("t"))
    with pytest.raises(PySparkException):
        write_joined(bad, "t", "id", path=path)
    assert open(path).read() == "old" and os.listdir(tmp_path) == ["all.txt"]


def test_graph_as_a_file(spark, tmp_path):
    odd = 'q"uote \\\\ back\x01\x1f\x7f \t tab é'
    bundle = Bundle(from_rows(spark, [("a.md", f"---\ntype: N\n---\n[{odd}](b.md) [x](c.md)\n"), ("b.md", "---\ntype: N\n---\n"), ("z.md", "---\ntype: N\nsources:\n- resource: a.md\n---\n")]))
    path = str(tmp_path / "g.json")
    render.write_graph_json(bundle, path, True)
    text = open(path, encoding="utf-8").read()
    assert text == render.graph_json(bundle, True)
    made = json.loads(text)
    assert [c["id"] for c in made["concepts"]] == ["a", "b", "z"] and made["concepts"][2]["sources"] == ["a"]
    assert [(k["target"], k["exists"]) for k in made["concepts"][0]["links"]] == [("b", True), ("c", False)]
    link = made["concepts"][0]["links"][0]
    assert json.dumps(link["text"], ensure_ascii=False) in text
    empty = Bundle(from_rows(spark, []))
    render.write_graph_json(empty, path)
    assert json.loads(open(path).read()) == {"concepts": []} and open(path).read() == render.graph_json(empty)
