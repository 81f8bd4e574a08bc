"""A training corpus from raw documents: five stages, each a DataFrame job of ``tersa.llm``.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns what the next one gets. All but the last keep the columns of
``documents``:

1. language: documents without a language go (a text that is null, has no letter,
   or lies beyond the limits that nearly all held-back learned rows keep).
2. toxicity: documents that score one half or more go.
3. near_duplicates: one document of each class of near copies stays.
4. secrets: secrets are masked in the text; every document stays.
5. packing: pieces of all documents in sequences of 1024 tokens.

An empty table passes through every stage. Rows with a null id are kept or
rejected by their text like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tersa.llm import language, ngram_join, packing, secret_scan, toxicity
from tersa.llm.common import load, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs)


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Learned models, encoding and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
