"""A training corpus from `documents`: toxic rows, near copies, repeated passages and benchmark leaks go, the rest is tokenised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import _env, decontamination, pieces, simhash, substrings, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier scores 0.7 or more go.

    Null and empty texts score alike, by the share of toxic labels; repeated rows stay or go
    together; without labels of both kinds nothing tells rows apart, and few labels are toxic.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 of their five-word shingles the row with the smallest doc_id stays.

    Texts without words, null ones included, are one group. Rows of a null doc_id stay; rows
    that share a doc_id stay or go together.
    """
    return simhash.keep_one(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that repeat anywhere are cut from the texts.

    No row goes; null, empty and shorter texts stay as they are.
    """
    return substrings.cut_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold 10 consecutive words of a benchmark item go, or all words of a shorter one.

    Null and empty texts stay; with an empty benchmark all do.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each text; `text` is what they decode to.

    A null text stays null, with null ids and 0 tokens.
    """
    return pieces.encode(docs, verify=True).withColumn("text", pieces.F.col("decoded")).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_copies),
    ("substring_dedup", cut_passages),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece", tokenise),
]

#: The classifier, the fingerprints and the sampled pieces have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and read again."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = _env.scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if old:  # nothing reads what the stage before last wrote
            _env.remove(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
