"""Decontamination as a join: many items, one reading of the documents, equal regions, rows that share an id."""

import random

from loomwright.llm import decontaminate


def words(rng, n):
    return [f"w{rng.randrange(50_000)}" for _ in range(n)]


def test_many_items_and_a_passage_in_many_documents(spark, monkeypatch):
    rng = random.Random(7)
    items = [(k, " ".join(words(rng, 6 + k % 40))) for k in range(1500)]
    hot = items[77][1]
    rows = [(i, " ".join(words(rng, 5)) + " " + (hot if i % 3 == 0 else items[i][1] if i % 3 == 1 else "") + " " + " ".join(words(rng, 5))) for i in range(900)]
    scans = []
    plain = decontaminate.regions_in
    monkeypatch.setattr(decontaminate, "regions_in", lambda *a: scans.append(1) or plain(*a))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    want = {(i, 77 if i % 3 == 0 else i) for i, _ in rows if i % 3 < 2}
    assert got == want
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {i for i, _ in rows if i % 3 == 2}


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    rows = [(1, "one two three four five six", "x"), (1, "something else", None), (None, "one two three four five six", "y"), (None, "one two three four five six", "y"), (None, None, "z"), (2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t1 string").withColumnRenamed("t1", "rid")
    bench = spark.createDataFrame([(5, "Two, three four FIVE"), (6, "two three four five")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.edit_distance, r.end_word) for r in decontaminate.matches(docs, bench).collect()), key=str)
    assert got == sorted([(d, k, 0, 5) for d in (1, None, None) for k in (5, 6)], key=str)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "something else", None), (None, None, "z"), (2, "", "z")], key=str)


def test_single_words_on_demand(spark):
    docs = spark.createDataFrame([(1, "a Golden day"), (2, "goldenrod"), (3, "golden")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "golden"), (6, "day")], "item_id long, text string")
    assert decontaminate.matches(docs, bench).count() == 0
    assert {(r.doc_id, r.item_id, r.end_word) for r in decontaminate.matches(docs, bench, min_words=1).collect()} == {(1, 5, 2), (1, 6, 3), (3, 5, 1)}


def test_bitmap_never_misses(spark):
    rng = random.Random(2)
    items = decontaminate.item_codes([" ".join(words(rng, n)) for n in (1, 2, 5, 30, 90)])
    for bits in (1 << 10, 1 << 20):
        import numpy as np

        flags = np.zeros(bits, dtype=np.uint8)
        for x in items:
            flags[decontaminate.filter_places(x, decontaminate.class_bounds(len(x))[0], bits)] = 1
        bitmap = np.packbits(flags, bitorder="little")
        for x in items:
            size = decontaminate.class_bounds(len(x))[0]
            marks = decontaminate._marks(x, size)[: max(1, len(x) - 1)]
            assert decontaminate._is_set(bitmap, decontaminate._of_class(marks, size)).all()
