"""Importance resampling against plain Python and DuckDB."""

import glob
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwright.llm import importance, queries

SF = "/root/testdata/sf0.001"


def plain(docs, target, longest, buckets, least, percent):
    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for doc_id, text in docs:
        n, fs = features(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, fs))
        rows.append((doc_id, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(able[: len(able) * percent // 100]):
        rank.setdefault(r[0], []).append(k + 1)
    return sorted(((r[0], *r[2:], (rank.get(r[0]) or [None]).pop(0) if r[1] >= least else None) for r in able + [r for r in rows if r[1] < least]), key=repr)


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (3, 50)])
def test_resampling_is_that_of_plain_python(spark, longest, percent):
    docs = [(i, f"Alpha beta{i % 7} GAMMA-delta, été {i % 3} " * (i % 9)) for i in range(200)] + [(None, None), (300, ""), (301, "\x00\x7f{}"), (5, "repeated words " * 30), (5, "repeated words " * 30), (302, "x" * 100_000), (303, "Å B")]
    target = [(1, "beta1 beta1 gamma zeta"), (2, None), (3, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("weight", F.lit(1)).withColumn("score", F.lit("x")).withColumn("_row", F.lit(2)).repartition(5)
    made = importance.resample(frame, spark.createDataFrame(target, "item_id long, text string"), longest, 50, percent=percent)
    assert made.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in made.dtypes} == {"bigint"}
    assert sorted(map(tuple, made.collect()), key=repr) == plain(docs, [t for _, t in target], longest, 50, 20, percent)


def test_ring_extends_by_space_and_word():
    ws = [b"a", b"bc", b"d", b"a"]
    assert Counter(importance.run_codes(ws, 3)) == Counter(zlib.crc32(b" ".join(ws[i:j])) for i in range(4) for j in range(i + 1, min(4, i + 3) + 1))
    assert importance.run_codes([], 3) == [] and importance.run_codes(ws, 1) == [zlib.crc32(w) for w in ws]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert [r.rank for r in importance.resample(some, none).collect()] == [None]


def test_hot_rows_are_ranked_each(spark):
    docs = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one word " * 20).alias("text"))
    made = importance.resample(docs, docs.limit(1))
    assert sorted(r["rank"] for r in made.collect() if r["rank"]) == list(range(1, 201))


def test_drawn_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    ranks = {r.doc_id for r in importance.resample(docs, target).where("rank is not null").collect()}
    drawn = importance.drawn_documents(docs, target)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == ranks and ranks


def test_query_matches_duckdb(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {f.rpartition('/')[2].removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    made = queries.op13_importance_resampling(spark, SF)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(made.collect()) == order(con.execute(queries.oracle_sql()["op13_importance_resampling"]).fetchall())
