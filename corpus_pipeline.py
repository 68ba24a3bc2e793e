"""The corpus pipeline: stages over documents, each calling an operator of skeinwork.llm.

Rows are documents; doc_ids may be null or repeat. Every stage but the last returns the columns of documents, with n_chars following the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import line_dedup, packing, quality, shingles, suffix_dedup
from skeinwork.llm.common import read_table, stored

#: Near copies: a Jaccard similarity of 4 / 5 of shingles of five words. The budget of bits only names the first candidates.
SHINGLE_WORDS, SHINGLE_BUDGET, SIMILARITY = 5, 7, (4, 5)


def _with_counts(docs: DataFrame, columns: list[str]) -> DataFrame:
    counted = docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in columns else docs
    return counted.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the base rules or the likelihood ratio reject go."""
    return quality.filter_documents(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: lines found in many documents go from all of them; a document that loses all lines stays, empty."""
    return _with_counts(line_dedup.dedup_lines(docs), docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2 with exact similarities: of the rows that links reach from one another, the one with the least doc_id
    stays (rows with a null one come last, ties go by text). Rows that are not linked stay, whatever their doc_id."""
    return shingles.drop_near_copies(docs, SHINGLE_WORDS, SHINGLE_BUDGET, SIMILARITY)


def suffix_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: bytes of strings that start in a smaller document go; characters cut in parts go whole."""
    return _with_counts(suffix_dedup.with_kept_texts(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token sequences of power-of-two lengths, with their ids."""
    return packing.pack_documents(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("suffix_dedup", suffix_deduplication),
    ("packing", pack_sequences),
]

#: Stages fit a model, link fingerprints and run a tokenizer, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage returns is written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
