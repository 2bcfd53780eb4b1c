"""The registered queries of this subpackage, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bradley_terry, decision_list, language_id, license_scan, mixing, ngram_lm, prefix_trie, sentencepiece_codec, simhash, source_audit, top_inner, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed values of the URL rules: host with path prefix → verdict.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    judged = decision_list.judge(docs, decision_list.learn(docs, _table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_norm_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode_documents(_table(spark, sf_dir, "documents"), public_model())
    return sentencepiece_codec.digests(encoded)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(_table(spark, sf_dir, "pages"))


def op6_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bradley_terry.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(mixing.mix(_table(spark, sf_dir, "documents")))


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op10_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(license_scan.scan(_table(spark, sf_dir, "documents")))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_link_graph": op1_link_graph,
    "op2_decision_list": op2_decision_list,
    "op3_norm_sorted": op3_norm_sorted,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_warc": op5_warc,
    "op6_bradley_terry": op6_bradley_terry,
    "op7_rank_profiles": op7_rank_profiles,
    "op8_systematic_mix": op8_systematic_mix,
    "op9_simhash_trie": op9_simhash_trie,
    "op10_elias_fano_lm": op10_elias_fano_lm,
    "op11_license_scan": op11_license_scan,
    "op12_source_audit": op12_source_audit,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_norm_sorted": top_inner.SQL,
    "op5_warc": warc.SQL,
    "op8_systematic_mix": mixing.SQL,
    "op12_source_audit": source_audit.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
