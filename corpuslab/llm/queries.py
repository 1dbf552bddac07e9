"""The numbered queries over ``documents`` and the SQL that checks them, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import (
    dart_minhash,
    disclosure,
    host_rules,
    infilling,
    label_shards,
    licenses,
    manifest,
    packing,
    partial_matching,
    prefix_bpe,
    sentence_spans,
    token_files,
    trie_dedup,
)
from corpuslab.llm.common import BYTE_BPE, WORD_BPE, documents, tokenizer_path
from corpuslab.staging import work_path


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(WORD_BPE))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), path, tokenizer_path(WORD_BPE))
    return token_files.token_digest(spark, path)


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.coding_digest(documents(spark, sf_dir), tokenizer_path(BYTE_BPE))


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.span_digest(documents(spark, sf_dir))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(documents(spark, sf_dir))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.remove_repeats(documents(spark, sf_dir))


def op8_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_shards.shard_documents(documents(spark, sf_dir))


def op9_trie_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.exact_owners(documents(spark, sf_dir))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_classes(documents(spark, sf_dir)).drop("text_key")


def op11_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    return partial_matching.score_texts(documents(spark, sf_dir), partial_matching.held_out_ids())


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, half of them checked against a tampered row."""
    return manifest.verify_manifest(documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of all documents, and the texts restored from them, as digests."""
    return infilling.infill_digest(documents(spark, sf_dir))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_license_scan": op2_license_scan,
    "op3_token_files": op3_token_files,
    "op4_prefix_bpe": op4_prefix_bpe,
    "op5_disclosure": op5_disclosure,
    "op6_host_rules": op6_host_rules,
    "op7_sentence_spans": op7_sentence_spans,
    "op8_label_shards": op8_label_shards,
    "op9_trie_dedup": op9_trie_dedup,
    "op10_dart_minhash": op10_dart_minhash,
    "op11_partial_matching": op11_partial_matching,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE = {
    "op6_host_rules": host_rules.ORACLE_SQL,
    "op9_trie_dedup": trie_dedup.ORACLE_SQL,
    "op12_merkle_manifest": manifest.ORACLE_SQL,
    "op13_fill_in_middle": infilling.ORACLE_SQL,
}
