"""The corpus pipeline: from raw documents to packed token sequences.

Each stage takes all that its predecessor kept; all but the last return the columns of
documents, whatever further columns those have. An empty table gives an empty table, and
rows that are repeated are judged alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import arrowkit, jaccard_join, lang_id, lpf_dedup, packing, quality
from weftgraph.llm.queries import BYTE_BPE
from weftgraph.session import materialize

#: Near copies: shingles of so many words, and the per cent of all shingles that must be shared.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their fitted accuracies reject go.

    A null, empty or wordless text has no words and goes; so do all texts below the base
    rules. Equal texts share their fate.
    """
    return quality.kept_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the labels teach go: without a letter, or without a likely language.

    A null or empty text goes. Where no row has a label, nothing can be taught and all go.
    """
    return lang_id.spoken_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Of rows with that id and equal sets of shingles one stays. Documents without words,
    null and empty texts among them, are no copies of each other: all stay.
    """
    return jaccard_join.one_of_each(docs, NEAR_PERCENT, NEAR_WORDS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of long passages go from the texts; every document stays.

    The copy with the smallest doc_id (null first) and start is kept. A null text becomes
    empty; rows that share an id are versions of one document and no copies of each other.
    """
    return lpf_dedup.deduped_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences of equal capacity.

    A null or empty text is its end id alone; of pieces of equal length any may take any
    of their slots.
    """
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]
#: Several stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = arrowkit.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = materialize(docs, f"pipeline-{i}")
    return docs
