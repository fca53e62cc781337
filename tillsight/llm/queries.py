"""Registered queries of the operators: name -> builder(spark, sf_dir), name -> DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import backoff, bpe, collocations, graph_dedup, html_text, minhash, packing, phrases, quality, search, simhash, suffix_dedup, toxicity
from tillsight.llm.common import table


def op10_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_nb_char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"))


def op7_deep_shallow_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op8_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op11_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.removals(table(spark, sf_dir, "documents"))


def op12_weighted_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_presence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op5_host_suffix_array": op5_host_suffix_array,
    "op8_robust_pruned_graph": op8_robust_pruned_graph,
    "op9_stupid_backoff": op9_stupid_backoff,
    "op7_deep_shallow_suffixes": op7_deep_shallow_suffixes,
    "op4_hilbert_packing": op4_hilbert_packing,
    "op6_segment_tree_bpe": op6_segment_tree_bpe,
    "op1_rule_ensemble": op1_rule_ensemble,
    "op3_nb_char_ngrams": op3_nb_char_ngrams,
    "op2_simhash_pivots": op2_simhash_pivots,
    "op10_one_permutation_minhash": op10_one_permutation_minhash,
    "op11_phrase_automata": op11_phrase_automata,
    "op12_weighted_automata": op12_weighted_automata,
    "op13_presence_masks": op13_presence_masks,
}

ORACLE: dict[str, str] = {
    "op9_stupid_backoff": backoff.ORACLE,
    "op11_phrase_automata": phrases.ORACLE,
    "op12_weighted_automata": collocations.ORACLE,
    "op13_presence_masks": search.ORACLE,
}
