"""The corpus pipeline: documents to a training mix, in stages that each write Parquet and read it again.

Each stage works on all rows that its predecessor kept; its decisions take effect. All but the last return the columns of
documents. Null texts, empty tables and repeated rows pass as the stages' operators define. Where one row of several equal
ones stays (near-duplicates), equal rows count as one document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratoframe.llm import decontaminate, factorization, line_dedup, simhash, source_mix
from stratoframe.llm.common import read, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Jaccard similarity of five-word shingles at which documents are near-duplicates.
SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for quality 0 go."""
    machine = factorization.train(docs, read(spark, sf_dir, "labels"))
    return factorization.scored(docs, machine, score="stage_score").filter("stage_score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; n_chars follows the text."""
    cleaned = line_dedup.drop_lines(docs)
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 or more of their five-word shingles the one with the least id stays."""
    return simhash.first_of_each(docs, similarity=SIMILARITY).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return source_mix.mix(docs).select(*COLUMNS)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mixture", mixture),
]

#: The first stage is a fitted classifier, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
