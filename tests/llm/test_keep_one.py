"""One row of each class: odd columns, shared ids, hot parts, and recall at the promised similarity."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import similar, simhash


@pytest.mark.parametrize("module", [simhash, similar])
def test_columns_of_any_name_and_type_stay(spark, module):
    rows = [(1, "a b c d e f g", {"k": 1}, 1.0, 7, "x"), (2, "a b c d e f g", {"k": 2}, 2.0, 7, None), (2, "unlike words in this other text", None, 3.0, 7, "y"), (2, "unlike words in this other text", {}, 3.0, 8, "y"), (None, "a b c d e f g", {}, None, 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, `a.b` double, kept_id int, fp string")
    kept = module.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    got = sorted(((r.doc_id, r.text, r["a.b"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, "a b c d e f g", 1.0), (2, "unlike words in this other text", 3.0), (None, "a b c d e f g", None)], key=str)
    assert sorted(map(str, module.keep_one(docs.repartition(3)).collect())) == sorted(map(str, kept.collect()))
    assert module.keep_one(docs.where("false")).count() == 0 and module.keep_one(docs.where("text is null")).count() == 0


def family(rng, base, n, changed):
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(len(copy)), changed):
            copy[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_hot_parts_keep_the_classes(spark, monkeypatch):
    """A large family and strangers that share its blocks, with tiny tiles: the same classes as without tiles."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = family(rng, base, 120, 2) + family(rng, base[:300] + [f"y{i}" for i in range(100)], 40, 2) + [" ".join(f"z{rng.randrange(10**6)}" for _ in range(100)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = lambda: {r.doc_id: r.component_id for r in similar.similar(docs).collect()}
    plain = classes()
    assert len({plain[i] for i in range(120)}) == 1 and len({plain[i] for i in range(160, 220)}) == 60
    monkeypatch.setattr(similar, "HOT_ROWS", 30)
    monkeypatch.setattr(similar, "TILE_ROWS", 10)
    assert classes() == plain


def test_recall_at_the_promised_similarity(spark):
    """Pairs of each similarity, alone and among strangers that share half of their shingles."""
    rng = random.Random(5)
    docs, pairs = [], []
    template = [f"t{rng.randrange(10**6)}" for _ in range(300)]
    for crowd in (False, True):
        for changed in (4, 8, 12, 13):
            for _ in range(60):
                own = [f"w{rng.randrange(10**6)}" for _ in range(300 if crowd else 600)]
                base = template + own if crowd else own
                copy = list(base)
                for at in rng.sample(range(len(base) - 300 if crowd else 0, len(base), 5), changed):
                    copy[at] = f"x{rng.randrange(10**6)}"
                sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, copy)]
                pairs.append((len(docs), len(sets[0] & sets[1]) / len(sets[0] | sets[1]), crowd))
                docs += [" ".join(base), " ".join(copy)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar(table).collect()}
    for crowd in (False, True):
        found = [got[i] == got[i + 1] for i, s, c in pairs if c == crowd and s >= 0.8]
        assert len(found) >= 150 and np.mean(found) >= 0.9
    strangers = [got[i] for i, _, _ in pairs]
    assert len(set(strangers)) == len(strangers)


def test_odd_input_of_keep_one(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "w " * 200_000), (5, "w " * 200_000)], "doc_id long, text string").withColumn("size", F.lit(1))
    assert {r.doc_id for r in similar.keep_one(docs).collect()} == {1, 4}
