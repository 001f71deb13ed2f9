"""The registered queries of this subpackage, and SQL that checks those SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runledger.llm.common import table
from runledger.llm.cover_tree import VECTORS_SQL, near_vectors
from runledger.llm.decontaminate import CONTAMINATION_SQL, contamination
from runledger.llm.html_text import extract_text
from runledger.llm.line_dedup import LINES_SQL, dedup_lines
from runledger.llm.manifest import MANIFEST_SQL, checked_manifest
from runledger.llm.mixing import MIX_SQL, mix
from runledger.llm.near_duplicates import near_duplicates
from runledger.llm.periodic import RUNS_SQL, periodic_runs, run_digests, with_planted_periods
from runledger.llm.pitman_yor import score_texts
from runledger.llm.quality import judge_quality
from runledger.llm.token_counts import Vocabulary, count_tokens
from runledger.llm.toxicity import toxicity
from runledger.llm.url_filter import URL_SQL, judge_urls
from runledger.session import ship_package, use_utc


# A public model file on the driver; its pieces travel with the job.
PIECES = os.environ.get("TOKENIZER_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document under a unigram vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, Vocabulary.from_sentencepiece(PIECES)).select(
        "doc_id", "n_tokens", "score", "n_unknown"
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix by source weights takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts of each document and whether rules keep it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge_quality(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of each page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", "n_chars")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that lie in ten-word windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of two-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, n=2, percent=80).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs of 50 words or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_words=50).select("doc_id", "text", "n_lines", "n_removed", "emptied")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated toxicity score for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted"
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of each document, and digests of what is left without them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return run_digests(periodic_runs(with_planted_periods(docs)))


def op12_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of embeddings of cosine 0.9 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), least=0.9)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and witness of each document, and whether a tampered one still leads to the root."""
    return checked_manifest(table(spark, sf_dir, "documents"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_token_counts": op2_token_counts,
    "op3_source_mix": op3_source_mix,
    "op4_quality": op4_quality,
    "op5_url_filter": op5_url_filter,
    "op6_html_text": op6_html_text,
    "op7_winnowing": op7_winnowing,
    "op8_hyperminhash": op8_hyperminhash,
    "op9_line_runs": op9_line_runs,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_cover_tree": op12_cover_tree,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def prepared(query: Callable[[SparkSession, str], DataFrame]):
        return lambda spark, sf_dir: query(ship_package(use_utc(spark)), sf_dir.rstrip("/"))

    return {name: prepared(query) for name, query in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_source_mix": MIX_SQL,
        "op5_url_filter": URL_SQL,
        "op7_winnowing": CONTAMINATION_SQL,
        "op9_line_runs": LINES_SQL,
        "op11_periodic_runs": RUNS_SQL,
        "op12_cover_tree": VECTORS_SQL,
        "op13_merkle_manifest": MANIFEST_SQL,
    }
