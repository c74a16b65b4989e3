"""Byte-pair encoding against the tokenizers library, and against merging by hand."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from loomwright.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "   ", "\n", "a", "<|endoftext|>", "x<|endoftext|><|startoftext|> y <|endoftext", "ΣΑΣ ΑΣ İstanbul ǅ ŉ Ⱥ Ⱦ", "日本語 テキスト \u0085x\x1c\x1dy 🎉🎉 é don't WE'LL 's", "é å", "A1b22-- '''re 're",
       "x" * 65, "ha" * 3000, "!" * 500, "1" * 200, "é" * 70, "word " * 400, " a b　c"]


@pytest.fixture(scope="module")
def merges():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Merges(f.read())


def by_hand(merges, word):
    """Leftmost pair of the lowest rank, again and again."""
    ids = [int(merges.inner[b]) for b in word[:-1]] + [int(merges.last[word[-1]])]
    while True:
        ranks = [(merges.rank_of.get(p, 1 << 60), i) for i, p in enumerate(zip(ids, ids[1:], strict=False))]
        if not ranks or min(ranks)[0] == 1 << 60:
            return ids
        rank, i = min(ranks)
        ids[i : i + 2] = [int(merges.made[rank])]


def test_trees_merge_the_leftmost_lowest_rank(merges):
    rng = random.Random(3)
    words = [bytes(rng.choice(b"aabcethings\xc3\xa9!") for _ in range(rng.randint(1, 64))) for _ in range(400)] + [b"a" * n for n in range(1, 65)]
    expected = [by_hand(merges, w) for w in words]
    assert merges.merge(words) == expected
    assert [merges.merge_long(w) for w in words] == expected
    assert merges.merge([]) == [] and merges.merge([b"xyz" * 100])[0] == by_hand(merges, b"xyz" * 100)


def test_plain_letters_are_split_as_the_library_splits(merges):
    for c in map(chr, range(0x300)):
        text = f"a{c}1A{c}{c}!'s {c}"
        assert merges._split(text) == [w for w, _ in merges.split.pre_tokenize_str(merges.normalizer.normalize_str(text))], hex(ord(c))


def test_every_code_point_is_encoded_as_the_library_does(merges):
    other = Tokenizer.from_file(PATH)
    points = [chr(c) for c in range(0x300, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f" a{c}1".join(points[i : i + 400]) for i in range(0, len(points), 400) for c in "́'"]
    for text, (ids, _) in zip(texts, merges.packed(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_digests_of_documents_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t, 1) for i, t in enumerate(ODD)] + [(None, "a b", 2), (10_001, "", 1)], "doc_id long, text string, ids int")
    whole = docs.withColumn("ids", F.lit(0)).unionByName(odd)
    other = Tokenizer.from_file(PATH)
    expected = []
    for r in whole.collect():
        ids = other.encode(r.text or "", add_special_tokens=False).ids
        text = other.decode(ids, skip_special_tokens=False)
        expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    made = bpe.digests(whole, PATH)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(expected, key=repr)
    assert made.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_encoded_and_decoded(spark):
    other = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    tokens = bpe.encoded(docs, PATH)
    assert {r.doc_id: r.ids for r in tokens.collect()} == {i: other.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(ODD)}
    texts = bpe.decoded(tokens.unionByName(spark.createDataFrame([(99, None)], tokens.schema)), PATH)
    assert {r.doc_id: r.text for r in texts.collect()} == {i: other.decode(other.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(ODD)} | {99: None}
    empty = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert bpe.digests(empty, PATH).count() == 0 and bpe.encoded(empty, PATH).count() == 0


def test_files_of_another_kind_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises((ValueError, KeyError)):
        bpe.Merges(f.read())


def test_words_kept_by_a_worker_are_bounded(merges, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    texts = [f"word{i} other{i} {'long' * 40}{i}" for i in range(40)]
    other = Tokenizer.from_file(PATH)
    for t in texts:
        [(ids, _)] = merges.packed([t])
        assert np.frombuffer(ids, "<u4").tolist() == other.encode(t, add_special_tokens=False).ids
    assert len(merges.ids) < 40 and all(len(w) <= bpe.KEPT_LETTERS for w in merges.ids)
