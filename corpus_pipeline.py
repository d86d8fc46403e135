"""The corpus pipeline: toxicity, language ID, near duplicates, mixing, BPE.

Each stage takes all rows that its predecessor kept, in a table that is written and read again. Documents with a toxicity
score of 0.5 or more go; so do those without a language or with one of low probability; of each group of near duplicates
the row of smallest doc_id stays (one without a doc_id only where none has any); the mix repeats, cuts or drops documents
until its sources meet their targets; the last stage gives each remaining text's number of tokens and digests. Empty tables
pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalog_loom.llm import bpe, jaccard, langid, mixing, toxicity
from catalog_loom.llm.shared import stage, table

ORACLE_SQL: str | None = None  # the models and the rounding of the mix are beyond SQL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
