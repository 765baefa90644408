"""A corpus pipeline of five stages over ``documents``; each stage is written as Parquet and read again."""

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm import bpe, cases, exact_dedup, jaccard, language, mixing
from tallybook.llm.common import Scratch, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or of which no language holds a fair part, go."""
    return language.in_a_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.without_exact_duplicates(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts stays."""
    return jaccard.one_of_each_component(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of every text's tokens."""
    return bpe.encoded_digests(docs, cases.VOCABULARY)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

# Language identification cannot be said in SQL. tests/llm holds dedup, near dedup and encoding against brute force,
# language and mixing against what they promise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
