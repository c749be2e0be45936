"""From raw documents to token-id files, in five stages.

Each stage takes what the one before kept, as a table with the columns of
``documents``, and is written before the next one reads it. The last reports on
the files it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpweave.llm import decontaminate, jaccard_join, language_id, mixing, token_counts, token_files
from dumpweave.llm.frames import aside
from dumpweave.llm.queries import MIX_REPEATS, table, tokenizer_file, workers_find_library
from dumpweave.plans.session import store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters, or told with a probability under a half, go."""
    workers_find_library(spark)
    return language_id.identified(docs, tokenizer_file("byte_bpe_50k.tiktoken"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a Jaccard similarity of 0.8 or more."""
    workers_find_library(spark)
    return jaccard_join.near_duplicate_survivors(docs, k=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    workers_find_library(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, each at least once.

    Weights are those of the ids that the token files will hold, with the end of each document.
    """
    workers_find_library(spark)
    own, back = aside(docs, "doc_id", "source", "text")
    counted = token_counts.with_token_counts(own, tokenizer_file("byte_bpe_50k.json"))
    # counted once, as the mixture reads them several times
    found = mixing.mixed(store(counted, compression="zstd"), F.col("n_tokens") + 1, mixing.Target(repeats=MIX_REPEATS))
    return back(found)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the mixture, and one row for each document in them."""
    workers_find_library(spark)
    return token_files.token_files(docs, tokenizer_file("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: Models, random orders and a tokenizer are beyond SQL; the tests hold the operators behind the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
