"""A corpus from documents to training sequences: each stage keeps or changes what the one before left.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the
columns of documents. A document goes if no language is found for it, if it is toxic,
or if a near copy with a smaller id stays; personal data in what is left is replaced;
the last stage packs the tokens into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import langid, packing, pii, simhash, toxicity
from millrace.llm.queries import PACKING_TOKENIZER
from millrace.session import staged, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, empty, or no letter) go."""
    return langid.keep_identified(docs, langid.fit(docs))


def without_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; labels of held-out documents are not learned from."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.keep_first(docs, shingle=simhash.NEAR_SHINGLE)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return pii.redact(docs, pii.fit(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its sequence and its place there."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path(PACKING_TOKENIZER)))


STAGES = [
    ("language_id", language_id),
    ("toxicity", without_toxicity),
    ("near_dedup", near_dedup),
    ("pii", without_pii),
    ("packing", sequences),
]

#: Classifiers, fingerprints and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
