"""A corpus pipeline over the documents table: five stages, each one of the corpus operators on its whole input.

1. Language ID: documents without a learned language (no letters) go; languages are learnt from the input itself.
2. MinHash near-dedup: one document of each class of near-duplicates stays.
3. Substring dedup: words under repeated 35-word windows are cut out; every document stays.
4. Benchmark decontamination: documents with at least a twentieth of their words in benchmark windows go.
5. SentencePiece: each text is encoded and decoded; a row says how many pieces it has and whether it came back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from costlens.llm import op1_minhash, op5_sentencepiece, op6_language, op8_decontaminate, op9_substrings
from costlens.llm.common import cut, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op6_language.learn(docs.filter(~op6_language.held_out()))
    return op6_language.keep_known(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_minhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_substrings.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_sentencepiece.round_trips(docs, public_tokenizers.path(op5_sentencepiece.MODEL), "doc_id")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", pieces),
]

#: The learnt language model and the piece coder can't be written as SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
