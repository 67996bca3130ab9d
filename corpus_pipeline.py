"""From raw documents to token files: the stages of the corpus pipeline.

Each stage takes all that the one before kept, and all but the last return the columns of ``documents``. Every
stage is written as Parquet and read again, so a lost executor repeats a stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlumen.llm import language, minhash, mixing, phrase_index, token_store
from revlumen.llm.common import read_table, staged

# Near-duplicates of documents: words per shingle and per cent of similarity.
SHINGLE, PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language.identified(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs, SHINGLE, PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return phrase_index.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source near its target; a document comes as often as it is taken."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks, described per document from the stored files."""
    return token_store.documents_query(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

# The language model, the sketches and the tokenizer are out of SQL's reach; brute-force versions test them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
