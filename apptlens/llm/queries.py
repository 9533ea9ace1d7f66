"""The registered queries of the text operators and the SQL some must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from apptlens.llm import best_fit_packing, compact_windows, count_vector_join, dual_tree_search, external_shuffle, filter_audit, html_wrappers, invertible_sketch, line_deletions, positional_index, quality_thresholds, secret_ownership, surrogates
from apptlens.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# The ranks of the same vocabulary.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# For tests; a real corpus needs a secret key.
SURROGATE_KEY = b"registered query"
SHARDS = 8
SHUFFLE_SEED = 20_240_601


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are sources; a repository is a source's part in one language."""
    docs = table(spark, sf_dir, "documents")
    return secret_ownership.scan(docs, "doc_id", "text", F.col("source"), F.struct("source", "lang"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymize(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passages(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, RANKS, public_tokenizers.PATTERN)


def op5_line_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_deletions.report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_thresholds.verdicts(table(spark, sf_dir, "documents"))


def op7_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.main_texts(table(spark, sf_dir, "pages"))


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external_shuffle.shards(table(spark, sf_dir, "documents"), "doc_id", "text", SHARDS, SHUFFLE_SEED)


def op10_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_vector_join.groups(table(spark, sf_dir, "documents"))


def op11_invertible_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invertible_sketch.fingerprints(table(spark, sf_dir, "documents"))


def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_ownership, op2_surrogates, op3_compact_windows, op4_best_fit_packing, op5_line_deletions, op6_quality_rules, op7_html_wrappers, op8_positional_index, op9_external_shuffle, op10_count_vector_join, op11_invertible_sketch, op12_dual_tree_search, op13_filter_audit)
}

ORACLES: dict[str, str] = {
    "op1_secret_ownership": secret_ownership.ORACLE_SQL,
    "op5_line_deletions": line_deletions.ORACLE_SQL,
    "op8_positional_index": positional_index.ORACLE_SQL,
    "op6_quality_rules": quality_thresholds.ORACLE_SQL,
    "op12_dual_tree_search": dual_tree_search.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
