"""Each operator against plain Python, and on odd input."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from loomwright.llm import decontaminate, html_text, langid, media, mixing, quality, secrets, simhash, similar, substring, toxicity
from loomwright.llm.common import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, size int, score string, block int"


def odd_docs(spark):
    """Nulls everywhere, empty, blank and long texts, repeated rows, and columns named like those that operators make."""
    long_text = "lorem ipsum dolor sit amet " * 20_000
    rows = [
        (1, None, None, None, None), (2, "", "en", "s1", 0), (3, " \t\n ", "en", "s1", 4), (4, "one", "en", "s1", 3), (4, "one", "en", "s1", 3),
        (None, "one", "en", None, 3), (None, None, None, None, None), (5, long_text, "de", "s2", len(long_text)), (6, long_text, "de", "s2", len(long_text)),
        (7, "Ünïcode wörds 日本語   here\x00 too", "fr", "é", 10), (8, "password = hunter2hunter2", "en", "s1", 20), (9, "a b c d e f g", "en", "s1", 13), (9, "other text with the same id", "en", "s1", 13),
    ]
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOCS)


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- connected components


def test_components_match_plain(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(300, 420)] + [(i, i + 1) for i in range(500, 560)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == plain_components(nodes, edges)


# --- toxicity


def test_toxicity_separates_and_grades(spark):
    words = "the of and to in is that for it as was with be by on not he his but at".split()
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + i % 7):
                text[rng.randrange(60)] = rng.choice(["vile", "scummy", "wretch"])
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab.where("doc_id % 3 <> 0"))
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert all(got[i].toxic == (i % 4 == 0) for i in range(0, 600, 3))
    assert all(0 <= r.expected_severity <= toxicity.GRADES for r in got.values())
    mean = lambda k: np.mean([got[i].expected_severity for i in range(0, 600, 12) if i % 7 in k])
    assert mean((5, 6)) > mean((0, 1))  # more of it is more severe


def test_toxicity_on_odd_input(spark):
    d = odd_docs(spark)
    labels = spark.createDataFrame([(4, None, 1), (None, 1, 1), (5, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        rows = toxicity.score(d, toxicity.fit(d, lab)).collect()
        assert len(rows) == d.count()
        assert not any(r.toxic for r in rows)
    assert toxicity.score(d.limit(0), toxicity.OrdinalModel({}, (1.0, 2.0, 3.0))).count() == 0


# --- substring


def plain_removal(rows, window):
    count = collections.Counter()
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in docs:
        for k in range(len(w) - window + 1):
            count[tuple(w[k : k + window])] += 1
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [3, 9, 18, 35])
def test_substring_matches_plain(spark, window):
    rng = random.Random(window)
    words = [f"w{i}" for i in range(400)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(window - 1, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(4)):
            text += [rng.choice(words) for _ in range(rng.randrange(40))] + rng.choice(shared)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    rows += [(90, " ".join(["same"] * 100)), (91, rows[3][1]), (91, rows[3][1]), (92, None), (93, "")]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()
    assert sorted(map(tuple, got), key=repr) == plain_removal(rows, window)


def test_covers_are_difference_covers():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_substring_on_table_and_odd_input(spark):
    for d in (documents(spark), odd_docs(spark)):
        rows = [(r.doc_id, r.text) for r in d.collect()]
        assert sorted(map(tuple, substring.remove_repeats(d).collect()), key=repr) == plain_removal(rows, 35)
    assert substring.remove_repeats(documents(spark).limit(0)).count() == 0
    kept = {r.doc_id: r.kept_text for r in substring.kept_texts(documents(spark)).collect()}
    digest = {r.doc_id: r.kept_sha256 for r in substring.remove_repeats(documents(spark)).collect()}
    assert all(hashlib.sha256(t.encode()).hexdigest() == digest[i] for i, t in kept.items())


# --- simhash


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_matches_plain(spark):
    for d in (documents(spark), odd_docs(spark)):
        rows = [(r.doc_id, plain_fingerprint(r.text)) for r in d.collect()]
        got = simhash.near_duplicates(d).collect()
        assert sorted((r.doc_id, int(r.fingerprint, 16)) for r in got if r.doc_id is not None) == sorted(x for x in rows if x[0] is not None)
        known = [x for x in rows if x[0] is not None]
        want = plain_components({i for i, _ in known}, [(a, b) for a, x in known for b, y in known if (x ^ y).bit_count() <= 4])
        assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert simhash.near_duplicates(documents(spark).limit(0)).count() == 0


def test_ball_join_finds_every_pair(spark, monkeypatch):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 6))))
    fps |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}  # a dense group
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "CHUNK", 20_000)  # so that the group is cut further inside the task
    to_signed = lambda x: x - 2**64 if x >= 2**63 else x
    d = spark.createDataFrame([(to_signed(f), i) for i, f in enumerate(fps)], "fp long, node long")
    edges = [(r.a, r.b) for r in simhash.links(d, len(fps)).collect()]
    want = plain_components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert plain_components(range(len(fps)), edges) == want


def test_chain_in_a_crowded_part(monkeypatch):
    """A chain of links whose ends are far apart stays whole where a part is cut further inside the task."""
    rng = random.Random(3)
    fps = [rng.getrandbits(40)]
    for _ in range(150):
        fps.append(fps[-1] ^ sum(1 << k for k in rng.sample(range(40), 4)))
    rng.shuffle(fps)
    fp = np.array(fps, dtype=np.uint64)
    for chunk in (simhash.CHUNK, 20_000):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        a, b = simhash.meet(fp, fp, np.full(len(fp), 2), 6, 4)
        assert set(plain_components(range(len(fp)), list(zip(a.tolist(), b.tolist(), strict=True))).values()) == {0}


def test_similar_classes(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, truth = [], []
    for i in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([60, 200, 500]))]
        docs.append(base)
        truth.append(i)
        for _ in range(i % 3):
            copy = list(base)
            for _ in range(len(base) // 100):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(copy)
            truth.append(i)
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    monkeypatch.setattr(similar, "CHUNK", 50_000)
    got = {r.doc_id: r.component_id for r in similar.similar(d).collect()}
    pairs = [(a, b) for a in range(len(docs)) for b in range(a) if truth[a] == truth[b]]
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in docs]
    close = [(a, b) for a, b in pairs if len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.85]
    assert len(close) > 50 and np.mean([got[a] == got[b] for a, b in close]) >= 0.97
    assert all(truth[got[k]] == truth[k] for k in got)  # no stranger is taken for a copy


def test_radius_must_be_even(spark):
    with pytest.raises(ValueError, match="even"):
        simhash.links(spark.createDataFrame([(1, 1)], "fp long, node long"), 1, radius=3)


def test_sample_is_bounded_under_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(300)] + [(2, None), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "doc_id long, quality int")
    rows = quality.labelled_sample(docs, labels, "quality", 2).collect()
    assert sorted((r.doc_id, r.text, r.y) for r in rows) == [(1, "t0", 1), (2, None, 1)]


@pytest.mark.parametrize("most", [similar.MOST_PART_ROWS, 0])
def test_routing_loses_no_pair(monkeypatch, most):
    """Values within four bits meet in a part, with five blocks and with two; brute force over all placements of flips."""
    monkeypatch.setattr(similar, "MOST_PART_ROWS", most)
    bits = 32
    blocks, lead, flips = similar.routing(100_000, bits)
    assert blocks == (5 if most else 2) and blocks * lead <= bits
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(400):
        base = int(rng.integers(0, 1 << bits))
        other = base
        for at in rng.choice(bits, int(rng.integers(1, 5)), replace=False):
            other ^= 1 << int(at)
        pair = np.array([base, other], dtype=np.uint64) << np.uint64(64 - bits)
        met = False
        for block in range(blocks):
            rows, value, left = similar.spread(similar.turned(pair, block * lead, bits), np.full(2, flips), 0, lead)
            part = value >> np.uint64(64 - lead)
            for p in np.unique(part):
                own = np.flatnonzero(part == p)
                a, b = similar.meet(value[own], left[own] + similar.HALF - flips, lead, bits)
                met |= any(rows[own[x]] != rows[own[y]] for x, y in zip(a, b, strict=True))
        assert met


def test_rows_sent_do_not_grow_with_documents():
    sent = lambda n: similar.routing(n, 32)[0] * (1 + similar.routing(n, 32)[2] * similar.routing(n, 32)[1])
    assert sent(1000) == sent(44_000) == sent(220_000) == sent(10**7) == 5
    for n in (10**8, 10**9, 10**10):
        blocks, lead, flips = similar.routing(n, similar.tables_for(n, 0.8)[0])
        assert blocks * (1 + flips * lead) <= 42 and blocks * lead <= similar.tables_for(n, 0.8)[0]


def test_tables_reach_recall():
    for count, similarity in ((1000, 0.8), (10**6, 0.9), (10**9, 0.8)):
        bits, tables = similar.tables_for(count, similarity)
        rng = np.random.Generator(np.random.PCG64(2))
        flips = rng.random((2000, tables, bits)) < similar.differing_share(similarity)
        assert np.mean((flips.sum(axis=2) <= 4).any(axis=1)) >= 0.95
        assert 2 ** (bits - 12) >= count or bits == 60


@pytest.mark.parametrize("module", [simhash, similar])
def test_keep_one(spark, module):
    d = odd_docs(spark)
    kept = module.keep_one(d)
    assert kept.columns == d.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert sorted(ids).count(4) == 1 and sorted(ids).count(9) == 2 and 6 not in ids and 5 in ids  # 9 has unlike texts
    assert sum(r.doc_id is None for r in rows) == 2
    assert module.keep_one(d.limit(0)).count() == 0


# --- language


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(d, *langid.fit(d)).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_ignores_held_out_lang(spark):
    d = documents(spark)
    from pyspark.sql import functions as F

    hidden = d.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    one, two = (sorted(map(tuple, langid.predict(x, *langid.fit(x)).collect())) for x in (d, hidden))
    assert one == two


def test_language_on_odd_input(spark):
    d = odd_docs(spark)
    rows = langid.predict(d, *langid.fit(d)).collect()
    assert len(rows) == d.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))
    assert langid.predict(d, *langid.fit(d.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(d.limit(0), ["en"], np.ones((1, langid.DIMENSIONS), np.float32)).count() == 0


def test_gram_vectors_bind_permuted_letters():
    v = langid.letter_vectors(64)
    grams = np.array([(97 << 20) | (98 << 10) | 99])
    assert (langid.gram_vectors(grams, 64)[0] == v[97] * np.roll(v[98], 1) * np.roll(v[99], 2)).all()


# --- mixing


def test_mixing_contract(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(d).collect()
    words = {r.doc_id: len(r.text.encode().split()) for r in d.collect()}
    assert {r.doc_id: r["size"] for r in rows} == words
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    source = {r.doc_id: r.source for r in d.collect()}
    took, target, size = collections.Counter(), {}, collections.Counter()
    for r in rows:
        s = source[r.doc_id]
        took[s] += r.taken
        size[s] += r["size"]
        target[s] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(words.values())) < 1
    assert all(target[s] <= 2 * size[s] and abs(took[s] - target[s]) <= 2 * mixing.BLOCK + 0.02 * target[s] for s in target)
    again = {(r.doc_id, r.taken) for r in mixing.mix(d.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_targets_and_draws():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([10, 1000], [3, 1]) == [20.0, 1495.0]
    assert mixing.targets([0, 0], [3, 1]) == [0.0, 0.0]
    plan = mixing.ShardCounts([1000, 37, 0, 5000], slots=64)
    counts = [plan.of(s) for s in range(plan.shards)]
    assert sum(c for c, _ in counts).tolist() == [1000, 37, 0, 5000]
    assert all(c.sum() == 64 for c, _ in counts[:-1])
    total = np.zeros(4, dtype=int)
    for c, before in counts:
        assert (before == total).all()
        total += c
    for n in (1, 2, 3, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, 7)) == list(range(n))


def test_mixing_on_odd_input(spark):
    d = odd_docs(spark)
    rows = mixing.mix(d).collect()
    assert len(rows) == d.count()
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(d.limit(0)).count() == 0
    assert mixing.mix(d.where("text is null")).count() == 2


def test_mixed_blocks_hold_the_words(spark):
    d = documents(spark)
    taken = {r.doc_id: r.taken for r in mixing.mix(d).collect()}
    blocks = mixing.mixed_blocks(d).collect()
    assert sum(len(b.text.split()) for b in blocks) == sum(taken.values())
    assert max(len(b.text.split()) for b in blocks) == mixing.BLOCK


# --- pages


PAGES = [
    ("<html><body><nav><a href=/>home</a> <a href=/x>x</a></nav><article><h1>Title &amp; more</h1><p>First <b>bold</b>\n text.<br>Second line<p>Third &eacute;</article><footer>&copy; me</footer></body></html>", "Title & more First bold text. Second line Third é"),
    ("<body><div class='sidebar'>buy</div><div id=main><h2>Head</h2><p>Some text that is long enough to be read.</p><ul><li>a point<li>another</ul></div><div class=comments><p>nice post, thank you so much for it</p></div></body>", "Head Some text that is long enough to be read. a point another"),
    ("<body><header><h1>Site</h1></header><main><section><h2>A</h2><p>aaa aaa aaa</p></section><aside>no</aside><section><p>bbb bbb</p></section><form><input>send</form></main></body>", "A aaa aaa aaa bbb bbb"),
    ("<article><p>see <script>var t='</p>';</script><style>p{}</style>this <!-- hidden --> here</p><div class='cookie-notice'>we use cookies</div></article>", "see this here"),
    ("just text < 3 &amp; more", "just text < 3 & more"),
    ("<p>unclosed <b>tags <i>everywhere", "unclosed tags everywhere"),
    (None, ""), ("", ""), ("   ", ""), ("<html><head><title>only</title></head><body></body></html>", ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_extract_table(spark):
    import html

    p = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.extract(p).join(p.select("page_id", "html"), "page_id").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1|br)[^>]*>", inner)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x", 1), (1, "u", "<p>x", 1), (2, None, "<p>" + "y " * 50_000, 1)], "page_id long, url string, html string, text int")
    rows = html_text.extract(odd).collect()
    assert [r.n_chars for r in rows] == [0, 1, 1, 99_999]
    assert html_text.extract(odd.limit(0)).count() == 0


# --- secrets


def test_base_spans_match_patterns(spark):
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    odd = ["secret=token: abcdefgh", "PassWord:'abcdef' ſecret=abcdefgh toKen=abcdefgh", "x" * 10 + "AKIA" + "A" * 16 + "AKIAB", "AKIA123", "é token = \"0123456789abcdef01234567\"", "0123456789abcdef0123456", "api_key=12345 apikey=123456", "日本 token:abcdefg", ""]
    texts = odd + [r.text for r in documents(spark).collect()]
    for t in texts:
        want = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secrets.base_spans(t) == sorted(want)
        assert set(want) <= set(secrets.spans_of(t)[1])


def test_guess_bits_order():
    bits = secrets.guess_bits
    assert bits("password") < 8 and bits("aaaaaaaaaaaaaaaa") < 12 and bits("qwertyuiop") < 14 and bits("monday2019") < 20
    assert bits("xK9#mQ2$vL7p") > 50 and bits("") == 0
    assert bits("correcthorse") <= 12 * np.log2(26) + 1e-9


def test_guessed_spans_and_redaction():
    text = "The passphrase is xK9#mQ2$vL7p. login: monday2019! token = 'zzzzzz9'"
    kinds = [secrets.KINDS[k] for _, k, _ in secrets.spans_of(text)[1]]
    assert kinds == ["guess", "assign"]
    assert secrets.redact(text) == "The passphrase is [secret]. login: monday2019! [secret]'"
    assert secrets.redact(None) is None
    assert secrets.spans_of("my login page is at the token office")[1] == []


def test_secrets_on_odd_input(spark):
    d = odd_docs(spark)
    rows = secrets.find(d).collect()
    assert len(rows) == d.count() and sum(r.n_assign for r in rows) == 1
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty and r.spans == "" for r in rows if r.doc_id in (1, 2, 3))
    assert secrets.find(d.limit(0)).count() == 0
    out = secrets.redacted(d)
    assert out.schema == d.schema and out.count() == d.count()


# --- pictures


def test_media_copies(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.media_id: r for r in media.copies(media.pictures(vectors)).collect()}
    edited = [i for i in rows if i % 8 == 7 and i - 7 in rows]
    assert np.mean([rows[i].class_id == rows[i - 7].class_id for i in edited]) >= 0.95
    others = [i for i in rows if i not in edited and i % 8 != 0]
    assert np.mean([rows[i].class_id == i for i in others]) >= 0.99


def test_media_matches_brute_force(spark):
    pictures = media.pictures(spark.read.parquet(f"{SF}/embeddings.parquet")).where("media_id < 64").collect()
    local = {r.media_id: media.describe(media.read_pgm(bytes(r.image))) for r in pictures}

    def copies(a, b):
        votes = collections.defaultdict(set)
        for (xa, ya, la), da in zip(*local[a], strict=True):
            for n, ((xb, yb, lb), db) in enumerate(zip(*local[b], strict=True)):
                if (da != db).sum() <= media.MOST_BITS:
                    ratio = media.SCALES[int(lb)] / media.SCALES[int(la)]
                    for i in (0, 2):
                        for j in (0, 2):
                            votes[round(ratio, 3), i, j, (xa - ratio * xb + i) // 4, (ya - ratio * yb + j) // 4].add(n)
        return any(len(v) >= media.LEAST_CORNERS for v in votes.values())

    ids = sorted(local)
    want = plain_components(ids, [(a, b) for a in ids for b in ids if a < b and copies(a, b)])
    got = {r.media_id: r.class_id for r in media.copies(spark.createDataFrame([(r.media_id, bytes(r.image)) for r in pictures], "media_id long, image binary")).collect()}
    assert np.mean([got[i] == want[i] for i in ids]) >= 0.9  # recall against all pairs


def test_media_on_odd_input(spark):
    pixels = media.write_pgm(np.random.Generator(np.random.PCG64(1)).integers(0, 255, (60, 60)))
    rows = [(1, None, 1), (2, b"", 1), (3, b"no picture", 1), (4, pixels, 1), (5, pixels, 1), (5, pixels, 1), (None, pixels, 1), (6, b"P5 9999 9999 255\nxx", 1)]
    got = media.copies(spark.createDataFrame(rows, "media_id long, image binary, content int")).collect()
    assert len(got) == len(rows)
    assert sorted((r.media_id, r.class_id) for r in got if r.media_id) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (6, 6)]
    assert media.copies(spark.createDataFrame(rows[:0], "media_id long, image binary")).count() == 0


# --- benchmark items


def plain_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((4, 9, 16, 20, 33, 50, 59))]
    docs = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(80))]
        if i % 2:
            leak = items[i % 7][1].split()
            for _ in range(rng.randrange(0, len(leak) // 3)):
                at = rng.randrange(len(leak))
                leak[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            text += [w.upper() + "," for w in leak] + [rng.choice(words) for _ in range(rng.randrange(30))]
        docs.append((i, " ".join(text)))
    clean = lambda t: re.findall("[a-z0-9]+", t.lower())
    want = {(i, k) for i, t in docs for k, x in items if plain_distance(clean(x), clean(t)) <= int(len(x.split()) * 0.2)}
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= want and len(found) >= 0.95 * len(want)
    exact = {(i, k) for i, t in docs for k, x in items if " ".join(clean(x)) in " ".join(clean(t))}
    assert exact <= found
    assert all(r.edit_distance == plain_distance(clean(dict(items)[r.item_id]), clean(dict(docs)[r.doc_id])) for r in got)


def test_decontamination_filter_and_odd_input(spark, monkeypatch):
    d, b = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(map(tuple, decontaminate.matches(d, b).collect()))
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 1 << 16)  # a crowded filter changes nothing
    assert sorted(map(tuple, decontaminate.matches(d, b).collect())) == one
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in d.collect()} - {r.doc_id for r in kept.collect()} == {x[0] for x in one}
    odd = odd_docs(spark)
    items = spark.createDataFrame([(None, "a b c d e f g"), (1, None), (2, ""), (3, "a B, c d e f g"), (3, "a b c d e f g"), (4, "one")], "item_id long, text string")
    got = decontaminate.matches(odd, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(9, 3)}
    assert decontaminate.matches(odd.limit(0), items).count() == 0 and decontaminate.matches(odd, items.limit(0)).count() == 0


# --- quality


def test_quality_held_out_accuracy(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(d, quality.fit(d, lab)).join(lab, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_additive_model_learns_interactions():
    rng = np.random.Generator(np.random.PCG64(4))
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit_additive(x, y)
    assert (0, 3) in model.pairs
    assert np.mean((model.score(x) > 0.5) == y) > 0.95


def test_quality_on_odd_input(spark):
    d = odd_docs(spark)
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (5, None, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels)
    rows = quality.score(d, model).collect()
    assert len(rows) == d.count() and not any(r.held_out for r in rows if r.doc_id is None)
    assert quality.score(d.limit(0), model).count() == 0
    assert quality.keep_good(d, model).schema == d.schema
    assert quality.fit(d, labels.limit(0)).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5
