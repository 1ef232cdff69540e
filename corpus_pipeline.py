"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, read again from Parquet, and returns the columns of ``documents``; the last one
returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm import decontam, minwise, packing, pii, quality
from kpiloom.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the trees fitted to the labelled ones accept."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by sets of five words in a row."""
    return minwise.keep_one(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew where a text changed."""
    found = pii.find(docs)
    touched = F.size(found.columns[-2]) + F.size(found.columns[-1]) > 0
    marked = found.select(*[F.col(f"`{c}`") for c in docs.columns if c != "n_chars"], F.struct("n_chars", touched.alias("anew")).alias("n_chars"), *found.columns[-2:])
    clean = pii.redact(marked)
    kind = docs.schema["n_chars"].dataType
    size = F.when(F.col("n_chars.anew"), F.length("text").cast(kind)).otherwise(F.col("n_chars.n_chars"))
    return clean.withColumn("n_chars", size).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0).drop("ids")


STAGES = [
    ("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal data", personal_data), ("packing", packed),
]

#: No stage but the PII patterns can be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "pipeline-stage")
    return docs
