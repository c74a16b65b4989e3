"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, html_text, importance, langid, media, mixing, quality, secrets, simhash, substring, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    """Path of a public vocabulary file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected toxicity severity of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps when repeated runs of 35 words go."""
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, *langid.fit(docs))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.find(_table(spark, sf_dir, "documents"))


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among pictures drawn from every embedding."""
    return media.copies(media.pictures(_table(spark, sf_dir, "embeddings")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document, scored by their counts in all documents."""
    return alignment.align(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every document is encoded by a vocabulary with word ends, and what that decodes to."""
    return bpe.digests(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document when a tenth is drawn towards the benchmark's word distribution."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_substring_dedup, op3_simhash_near_dedup, op4_language_id, op5_mixing, op6_html_extraction, op7_secret_scan, op8_media_copies, op9_decontamination, op10_quality, op11_tokenizer_alignment, op12_bpe, op13_importance_resampling)}


#: op2 in DuckDB: every window of 35 words as text, counted; the words that repeated windows cover are left out.
_SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM d WHERE len(ws) >= 35)),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT doc_id, i, unnest(generate_series(0, 34)) AS o FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1))),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS p FROM d WHERE len(ws) > 0),
kept AS (SELECT w.doc_id, count(g.p) AS n_removed, string_agg(w.w, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS kept FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


#: op13 in DuckDB: CRC-32 of every distinct word, byte by byte with a table made bit by bit; counts, gains and ranks.
_IMPORTANCE = r"""
WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT i, v FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
known AS MATERIALIZED (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
crc AS (SELECT w, h, 0::BIGINT AS p, 4294967295::BIGINT AS c FROM known
  UNION ALL SELECT w, h, p + 1, xor(c >> 8, t.v) FROM crc JOIN tab t ON t.i = xor(c, (strpos('0123456789ABCDEF', h[2 * p + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * p + 2]) - 1) & 255 WHERE 2 * p < length(h)),
bucket AS MATERIALIZED (SELECT w, xor(c, 4294967295) % 10000 AS k FROM crc WHERE 2 * p = length(h)),
s AS (SELECT k, count(*) AS n FROM dw JOIN bucket USING (w) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bw JOIN bucket USING (w) GROUP BY k),
size AS (SELECT (SELECT count(*) FROM dw)::DOUBLE + 10000 AS s, (SELECT count(*) FROM bw)::DOUBLE + 10000 AS t),
gain AS (SELECT s.k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * size.s / ((s.n + 1)::DOUBLE * size.t)))::BIGINT AS g FROM s LEFT JOIN t USING (k), size),
weight AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM dw JOIN bucket USING (w) JOIN gain USING (k) GROUP BY doc_id),
noise AS (SELECT doc_id, list_sum(list_transform(range(1, 9), lambda q: (strpos('0123456789abcdef', sha256('2024:' || doc_id)[q]) - 1) * power(16, 8 - q))) AS h FROM d),
scored AS (SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weight w ON w.doc_id = d.doc_id JOIN noise n ON n.doc_id = d.doc_id),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END::BIGINT AS rank FROM scored s LEFT JOIN able a ON a.doc_id = s.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """The queries that have an SQL form; tests/llm holds the others against plain Python."""
    return {"op2_substring_dedup": _SUBSTRING, "op13_importance_resampling": _IMPORTANCE}
