"""A training-data pipeline over ``documents``: quality rules, line dedup,
near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. A stage's result is written as
Parquet in the shared folder and read back as the next one's input, so a lost
executor repeats part of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from odonto.llm import lines, mixing, neardup, packing, rules
from odonto.llm.common import stage

TOKENIZER = "word_bpe_49k.json"
#: Near duplicates share four fifths of their shingles or more.
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps (operator 3)."""
    return rules.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus (operator 7)."""
    return lines.deduped_documents(docs, equal_chars=lines.EQUAL_CHARS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, at 80 % of shared shingles
    (operator 6)."""
    return neardup.distinct_documents(docs, percent=PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as mixed to the source weights: once for each pass that
    takes words of them, with the words taken (operator 5)."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mixed documents and their places in packed
    sequences (operator 10)."""
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Near-duplicate groups and packing are not SQL; tests compare the stages
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
