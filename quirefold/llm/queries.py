"""The registered queries of this subpackage: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, collocations, decontaminate, hilbert, htmltext, langid, media, minhash, packing, substrings, suffixes, tokens, urlrules

Query = Callable[[SparkSession, str], DataFrame]
#: (verdict, host/path) of the URL rules that the query applies.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many of its words are in windows of benchmark items, which items, and whether it is contaminated."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the smallest doc_id of its group of near-duplicates, and whether it is that one."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words removed as repeats of 20 words, digest of the rest."""
    return substrings.deduplicated_words(_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its main text."""
    return htmltext.main_text(_table(spark, sf_dir, "pages"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: shard and slot in Hilbert order of language, source and size, under the law of rows."""
    return hilbert.shard_documents(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of at most 2048 tokens: its sequence and offset."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: host, path, the longest rule that fits and its verdict; allow without one."""
    return urlrules.judge_urls(_table(spark, sf_dir, "pages"), urlrules.rules_table(spark, URL_RULES), ["page_id"])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether these are over 1024."""
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: predicted language and score, learned from the folds that are not held out."""
    return langid.identify_documents(_table(spark, sf_dir, "documents"), ["doc_id"])


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its bytes as a WAV file, read back: sizes, digests and the spectral fingerprint."""
    stored = media.text_to_media(_table(spark, sf_dir, "documents"))
    return media.media_features(stored, ["doc_id", "n_bytes"])


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: the 2000 best phrases of 2 to 5 words, with their counts and scores."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: its cluster after ten rounds, the squared distance and the inertia."""
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes removed as repeats of 50 bytes of an earlier document, their runs, digest of the rest."""
    return suffixes.deduplicated_bytes(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_html_text": op4_html_text,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_url_rules": op7_url_rules,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_media_columns": op10_media_columns,
    "op11_collocations": op11_collocations,
    "op12_centroids": op12_centroids,
    "op13_suffix_dedup": op13_suffix_dedup,
}
