"""A corpus pipeline of operators of lociweave.llm, each stage written before the next reads it.

All stages take documents with any further columns, whatever their names, and give all but the last
the same columns again.  A stage's empty input gives an empty output.  Texts are read whole, however
long.  Rows need no doc_id, and doc_id may be repeated: rows are judged one by one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm import exact_dedup, packing, quality, simhash, substring_dedup
from lociweave.operators.shared import remove_folder, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier keep; null and empty texts go, equal rows share a verdict."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest doc_id; null counts as empty.

    Of rows that repeat doc_id and text the one whose columns sort first as JSON stays.
    """
    return exact_dedup.keep_first_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints, the one with the smallest doc_id.

    Texts without words are one component.  Where the smallest doc_id is repeated in a component, hashes of
    doc_id and text decide; rows of other components with the same doc_id are left alone.
    """
    return simhash.keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that are found elsewhere too; null stays null, equal rows are copies."""
    return substring_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes among fixed-length sequences; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_copies), ("near dedup", near_copies), ("substring dedup", repeated_passages), ("packing", packed)]

#: A fitted classifier, XXH64 fingerprints and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others are written to the shared folder and read again.

    A stage's output is deleted once the next is written; the last stage's input stays, as its rows are read later.
    """
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out.write.parquet(f"{home}/{k}")
            docs = spark.read.parquet(f"{home}/{k}")
            if k:
                remove_folder(spark, f"{home}/{k - 1}")
    return out
