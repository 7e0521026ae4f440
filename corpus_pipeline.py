"""From documents to a tokenised mix: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as
Parquet to the shared folder and hands the reread table to the next one. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, langid, mixing, secrets, simhash
from weftgraph.llm.common import arrow_rows, n_words
from weftgraph.plans.lineage import shared_dir, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language can't be told: those without a letter (and null ones), and those
    whose bytes the network gives to no language with a mean probability of 0.5, or of what all but a
    thousandth of the labelled texts with a letter reach if that is less: all of them are scored, and scores
    are written once. With no labels every text that has a letter stays."""
    net = langid.learn(docs.select("text", "lang"))
    if net is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    with arrow_rows(spark, 500):
        told = stored(langid.predict(docs.select(row, "text"), net).select("_row", "lang_pred", "score").where(F.col("lang_pred") != "und"))
    floor = langid.floor_of(told.where("_row.lang is not null"))
    return told.where(F.col("score") >= floor).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one of least doc_id: documents link
    when their five-word shingles have a Jaccard similarity of 0.8 or more."""
    return simhash.drop_near_duplicates(docs, n=5, least=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; no document goes."""
    return secrets.redact_secrets(docs, F.col("source"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document stands in it as often as its source's target and the sample say."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    d = docs.select(row, "doc_id", "source", n_words(F.col("text")).alias("_n"))
    favour = F.least(F.lit(1.0), F.lit(float(mixing.LONG)) / F.greatest(F.col("_n"), F.lit(1)))
    return mixing.repeat_rows(mixing.mix_sources(d, F.col("_n"), favour=favour)).select("_doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with token ids and their number."""
    return bpe.bpe_encode(docs, bpe.default_vocabulary())


STAGES = [("language", language), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix", mix), ("tokens", tokens)]

#: No SQL has the network, the forest or the encoder; tests/llm/test_pipeline.py holds each stage
#: against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread; the last one's rows."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
