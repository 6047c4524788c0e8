"""From raw documents to packed training sequences, one operator of ``galeframe.llm`` a stage.

Every stage takes null and empty texts as empty, keeps further columns whatever
their names, repeats its decision for repeated rows (exact dedup leaves one of
them), and makes an empty table of an empty one. Rows with a null id are judged
by their text in the first two stages, take no part in the next two, and are
packed like all others. Very long texts are read whole.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from galeframe.llm import decontaminate, exact_dedup, packing, similar, toxicity
from galeframe.llm.common import stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is fitted on a bounded sample of the labelled ones."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a similarity of 0.8 or more, the one with the smallest id stays."""
    return similar.drop_similar(docs, n=5, threshold=Fraction(8, 10))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its sequence and its place there."""
    return packing.pack(packing.cut_documents(docs))


STAGES = [
    ("toxicity", toxic),
    ("exact dedup", copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", leaks),
    ("best-fit packing", packed),
]

#: A learned score decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs)
    return docs
