"""Registered queries of the text operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, decontaminate, licenses, linequality, mixing, neardup, prefixtrie, ranker, substrings
from . import tokenfiles, toxicity, urlfilter, whitening
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from pairs of labelled ones."""
    return ranker.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: start, n_tokens and ids_crc32 per document."""
    return tokenfiles.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeated 200-byte strings cover."""
    return substrings.dedup_substrings(table(spark, sf_dir, "documents")).drop("spans")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and texts in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, with the item."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in repeated content-defined chunks, and in those removed as later copies."""
    return chunks.dedup_chunks(table(spark, sf_dir, "documents")).drop("kept")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page; listed are the canonical URLs that several pages share."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(list(urlfilter.RULES), "rule string, verdict string")
    judged = urlfilter.judge_urls(pages, rules, urlfilter.repeated_urls(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdict of every document."""
    return linequality.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, two-word shingles, 80 %."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on their 32 leading components, whitened."""
    return whitening.per_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, their heads exchanged by the rule of the contract."""
    turns = prefixtrie.ordered_turns(table(spark, sf_dir, "conversations"))
    return prefixtrie.trie(*prefixtrie.with_shared_heads(turns))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, from matched clauses and labelled documents."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_decontamination": op3_decontamination,
    "op4_chunk_dedup": op4_chunk_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_line_quality": op6_line_quality,
    "op7_quality_ranker": op7_quality_ranker,
    "op8_token_files": op8_token_files,
    "op9_mixture": op9_mixture,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_toxicity": op13_toxicity,
}

ORACLE: dict[str, str] = {
    "op2_license_scan": licenses.oracle(),
    "op5_url_filter": urlfilter.ORACLE,
    "op6_line_quality": linequality.ORACLE,
    "op12_prefix_trie": prefixtrie.ORACLE,
}
