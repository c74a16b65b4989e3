"""Corpus pipeline: five stages from raw documents to a mix, each a job of its own.

Every stage takes all rows that its predecessor kept and returns the columns of ``documents``; the last
returns what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import decontaminate, mixing, quality, secrets, similar


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and blank texts have all features zero and are judged like any other. Repeated rows are judged each; an empty
    table stays empty, and without labels of both kinds every document has the same score."""
    return quality.keep_good(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays.

    It is the one with the smallest doc_id. Texts without words are alike, so one of them stays. Of rows that agree in
    doc_id and text one stays; unlike texts with one doc_id both stay. Rows without doc_id all stay; an empty table
    stays empty."""
    return similar.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and blank texts hold none and stay, as do all documents where there are no items. Rows are judged by their texts,
    so repeated rows go or stay together; an empty table stays empty."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; all documents stay.

    Null texts stay null and get a null n_chars, blank ones are unchanged; repeated rows are all kept, and an empty table
    stays empty."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of the sources takes of every document.

    Null and blank texts have size 0 and give nothing. A null source is a source of its own. Repeated rows, and rows with
    one or no doc_id, count each; an empty table gives an empty mix."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_filter),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("mixing", mixing_stage),
]
#: The classifier, the fingerprints and the draws have no SQL form; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
