"""A training-data pipeline: documents in, token files out.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontam, mixing, ngram_join, quality, token_files
from folioflow.llm.common import keep, work_dir
from folioflow.llm.queries import tokenizer_path
from folioflow.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship_package(spark)
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship_package(spark)
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order; documents of sources that need more words than they have come twice."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in the shared work folder, in training order, and where each document is in them.

    docs must be read from the files that the mix was written to: the number of
    a row's file and its place there are its place in the mix.
    """
    ship_package(spark)
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    order = {"_part": number, "_name": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")}
    return token_files.token_output(docs.select("doc_id", "text", *[x.alias(c) for c, x in order.items()]), tokenizer_path(), list(order))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
    ("token output", token_output),
]

#: The Jaccard join, the seeded mix and the tokenizer have no form in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents in sf_dir; each stage's result but the last is a written table."""
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, f"{folder}/{k}")
    return docs
