"""Every stage of the pipeline on nulls, blank and long texts, repeated rows, clashing columns and no rows at all."""

import pytest
from test_operators import odd_docs

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_on_odd_input(spark, tmp_path, name, stage):
    docs = odd_docs(spark)
    out = stage(spark, docs, SF)
    out.write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    before, after = docs.collect(), got.collect()
    if name == "mixing":
        assert len(after) == len(before) and all(r.taken == 0 for r in after if r["size"] == 0) and all(r.taken <= 2 * r["size"] for r in after)
    else:
        assert got.columns == docs.columns
    ids = lambda rows: sorted(map(str, (r.doc_id for r in rows)))
    if name in ("decontamination", "secrets"):  # none of these holds an item
        assert ids(after) == ids(before)
    if name == "secrets":
        by = {r.doc_id: r for r in after if r.doc_id is not None}
        assert by[8].text == "[secret]" and by[8].n_chars == 8 and by[1].text is None and by[1].n_chars is None
    if name == "simhash_dedup":
        assert sum(r.doc_id is None for r in after) == 2 and {4, 5, 7, 8, 9} <= {r.doc_id for r in after} and 6 not in {r.doc_id for r in after}
    empty = stage(spark, docs.where("false"), SF)
    assert empty.count() == 0 and (name == "mixing" or empty.columns == docs.columns)
    blank = stage(spark, docs.where("text is null or trim(text) = ''"), SF)
    assert blank.count() <= docs.count()
