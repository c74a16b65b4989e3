"""Cross-tokenizer alignment against plain Python over the libraries' own tokens."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm import alignment

FILES = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a", "<|endoftext|> and <s> here", "un▁der", "日本語 テキスト 🎉🎉 é", "ﬁne ① ½", "\x00\x01 tab\t", "don't WE'LL 's", "q" * 3000, "xyz" * 500, "  spaces   between  ", "é", "Ⱥ ΑΣ", " " * 12_000 + "end", "ab " * 4000]


def letters():
    own = [b for b in range(256) if chr(b).isprintable() and chr(b) not in "  \xad"]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


@pytest.fixture(scope="module")
def plain():
    """doc texts -> groups of each text, by the definition."""
    a, byte = Tokenizer.from_file(FILES[0]), letters()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])

    def groups(text):
        if not text:
            return []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte[x] for x in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return []
        out, i, j, end_a, end_b = [], 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            left, right = [], []
            while not left or end_a != end_b:
                if not left or end_a < end_b:
                    left.append(ids_a[i])
                    end_a += len(bytes_a[i])
                    i += 1
                else:
                    right.append(ids_b[j])
                    end_b += len(bytes_b[j])
                    j += 1
            out.append((left, right))
        return out

    return groups


def expected(texts, groups):
    found, held = [groups(t) for t in texts], Counter()
    times = []
    for gs in found:
        times.append(Counter())
        for left, right in gs:
            for (x, n), (y, m) in ((p, q) for p in Counter(left).items() for q in Counter(right).items()):
                times[-1][x, y] += n * m
        held.update(times[-1].keys())
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    rows = []
    for gs, own in zip(found, times, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        rows.append((sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), sum(len(x) * len(y) for x, y in gs), sum(n for p, n in own.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return rows, held, most


def test_documents_and_odd_texts(spark, plain, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "one more"), (1001, "one more"), (1001, "one more")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("x")).withColumn("n_a", F.lit(1)).repartition(3)
    rows, _, _ = expected([t for _, t in docs], plain)
    made = alignment.align(frame, *FILES)
    assert made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(((d, *r) for (d, _), r in zip(docs, rows, strict=True)), key=repr)


def test_many_blocks_stripes_and_parts(spark, plain, monkeypatch):
    """Small bounds, so that a file has several blocks, a stripe few rows and its pairs many tasks. Bounds that only the
    driver reads are those of the plan; blocks are made in tasks, whose own bound is kept."""
    monkeypatch.setattr(alignment, "STRIPE_BYTES", 800 << 20)
    monkeypatch.setattr(alignment, "TASK_PAIRS", 100)
    texts = [f"alpha Beta{i % 5} gamma ünder {'z' * (i % 40)} the the the" for i in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    rows, held, most = expected(texts, plain)
    assert sorted(map(tuple, alignment.align(frame, *FILES).collect())) == [(i, *r) for i, r in enumerate(rows)]
    counts = {(r.a, r.b): (r.documents, r.best) for r in alignment.pair_counts(frame, *FILES).collect()}
    assert counts == {p: (n, n == most[p[0]]) for p, n in held.items()}


def test_slices_and_blocks_cut_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 100, None, "b" * 5000, "", "c"]})
    parts = list(alignment._slices(iter([batch]), 1000))
    assert [t for _, texts, _ in parts for t in texts] == [b"a" * 100, None, b"b" * 5000, b"", b"c"] and len(parts) == 3
    assert list(alignment._slices(iter([batch.slice(0, 0)]))) == []


def test_pieces_of_a_group_meet_in_slices(plain, monkeypatch):
    """Links come whole when a slice of pairs ends inside a group."""
    monkeypatch.setattr(alignment, "_SLICE_PAIRS", 7)
    with open(FILES[0], encoding="utf-8") as f, open(FILES[1], "rb") as g:
        both = alignment.Tokenizers(f.read(), g.read())
    texts = [t.encode() for t in ("qzxj" * 30, "Mississippi 12345", "日本語テキスト")]
    doc, pair, times = alignment.Linked(both, *both.encode(texts)).pairs()
    found = Counter()
    for d, p, n in zip(doc.tolist(), pair.tolist(), times.tolist(), strict=True):
        found[d, p // 32_000, p % 32_000] += n
    assert len(found) == len(pair)
    assert found == Counter((d, x, y) for d, t in enumerate(texts) for left, right in plain(t.decode()) for x in left for y in right)


def test_plain_letters_are_encoded_alike_by_both_libraries():
    with open(FILES[0], encoding="utf-8") as f, open(FILES[1], "rb") as g:
        both = alignment.Tokenizers(f.read(), g.read())
    for c in map(chr, range(0x300)):
        for text in (f" a{c}1A{c}{c}!'s {c}  {c}", f" {c * 3}\n {c}"):
            assert both.quick.encode_ordinary(text) == both.whole.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_groups(spark, plain):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    made = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in alignment.aligned_groups(docs, *FILES).collect()}
    assert made == {i: plain(t) for i, t in enumerate(ODD)}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, *FILES).count() == 0
    assert alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), *FILES).collect()[0].n_a == 0
