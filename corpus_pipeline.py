"""A training corpus from ``documents``: quality rules, toxicity, near copies, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and all rows that the one before kept. The first four return documents with
the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataframe.llm import best_fit_packing, mix_sources, ngram_jaccard, quality_rules, toxicity
from strataframe.llm.common import cut, spread, table
from strataframe.session import ship


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_documents(docs)


def harmless_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a machine trained on the labels of the documents that came this far."""
    ship(spark)
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    ship(spark)
    return ngram_jaccard.one_of_each(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix takes, in training order."""
    return mix_sources.mixed_documents(docs)


def packed_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, tokenized and packed."""
    ship(spark)
    return best_fit_packing.pack_documents(docs, best_fit_packing.tokenizer_file())


STAGES = [
    ("quality_rules", good_documents),
    ("toxicity", harmless_documents),
    ("ngram_jaccard", distinct_documents),
    ("mix_sources", mixed_documents),
    ("best_fit_packing", packed_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, a table between each two."""
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else cut(docs), sf_dir)
    return docs


#: The stages learn, hash into sketches and tokenize; tests hold them against brute force instead.
ORACLE_SQL = None
