"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import (
    arrowkit,
    html_wrapper,
    jaccard_join,
    lang_id,
    lpf_dedup,
    media,
    oracle,
    packing,
    piece_fst,
    quality,
    simhash_tree,
    source_audit,
    token_files,
    url_lm,
    whitening,
)

#: The public vocabulary of ids in token files and packs, and its size.
BYTE_BPE = "byte_bpe_50k.json"
BYTE_BPE_SIZE = 50_257
#: The public model of pieces.
PIECE_BPE = "piece_bpe_32k.model"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(arrowkit.documents(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf_dedup.dedup_report(arrowkit.documents(spark, sf_dir))


def op3_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.round_trips(arrowkit.documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.media_column(arrowkit.documents(spark, sf_dir)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(arrowkit.documents(spark, sf_dir))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(arrowkit.documents(spark, sf_dir))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_texts(arrowkit.pages(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = arrowkit.documents(spark, sf_dir)
    return token_files.token_files(docs, public_tokenizers.path(BYTE_BPE), BYTE_BPE_SIZE)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(arrowkit.documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.url_filter(arrowkit.pages(spark, sf_dir)).drop("score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(arrowkit.documents(spark, sf_dir))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tree.near_duplicates(arrowkit.documents(spark, sf_dir))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(arrowkit.embeddings(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_sentencepiece_wfst": op3_sentencepiece_wfst,
        "op4_media_columns": op4_media_columns,
        "op5_quality_rules": op5_quality_rules,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_html_extraction": op7_html_extraction,
        "op8_token_files": op8_token_files,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_url_filters": op10_url_filters,
        "op11_source_divergence": op11_source_divergence,
        "op12_simhash_near_dedup": op12_simhash_near_dedup,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    """The other queries hold models, files or spectra that SQL can't express; tests check them by brute force."""
    return {
        "op6_ngram_jaccard_join": oracle.OP6_NGRAM_JACCARD_JOIN,
        "op10_url_filters": oracle.OP10_URL_FILTERS,
        "op11_source_divergence": oracle.OP11_SOURCE_DIVERGENCE,
    }
