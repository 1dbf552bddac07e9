"""Corpus preparation in five stages, from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes
each result as Parquet in the shared folder and reads it back for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import dart_minhash, disclosure, host_rules, packing, trie_dedup
from corpuslab.llm.common import WORD_BPE, documents, staged, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the verdict on their host."""
    return host_rules.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return trie_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return dart_minhash.drop_near(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with identifiers and disclosing words masked."""
    return disclosure.sanitise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in training sequences."""
    return packing.pack(docs, tokenizer_path(WORD_BPE))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]

# Sub-word ids, signatures and the packing plan are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the whole table of documents."""
    docs = documents(spark, sf_dir)
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
