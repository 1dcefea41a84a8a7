"""A document pipeline out of the training-data operators.  Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataprof.llm import byte_bpe, decontaminate, lang_id, line_dedup, minhash
from strataprof.llm.common import cut, table, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter or that no language model explains."""
    docs = docs.select(COLUMNS)
    found = lang_id.classify(docs, lang_id.fit(docs), keep=COLUMNS)
    return found.where(~F.col("rejected")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more repeat stay in the last of them only."""
    found = line_dedup.drop_repeated_lines(docs, keep=["lang", "source"])
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group stays: five-word shingles, similarity of 0.8 or more."""
    gone = minhash.near_duplicates(docs, words=5, percent=80).where("doc_id is not null and not kept").select("doc_id")
    return without(docs, "doc_id", gone).select(COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return byte_bpe.round_trip(docs, byte_bpe.default_ranks())


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("minhash", near_duplicates),
    ("decontaminate", benchmark_leaks),
    ("byte_bpe", encode),
]

#: SQL can express neither the language models nor the alignment; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
