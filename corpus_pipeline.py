"""Documents to packed training sequences: rules, quality model, near duplicates, mixing, packing.

Every stage takes null ids and texts, repeated rows, empty tables and columns of any name, and
all but the last give rows of documents as they were: null and empty texts are rejected by the
rules; rows without an id are judged, compared and mixed like others; repeated rows count each,
until one of them stays in the near-duplicate stage; no stage fails for want of labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm.common import Scratch
from strata.llm.gam import keep_by_quality
from strata.llm.mixing import mixed
from strata.llm.ngram_join import keep_first_of_each
from strata.llm.packing import pack_documents
from strata.llm.rules import keep_by_rules


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return keep_by_rules(docs, _labels(spark, sf_dir))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model finds likelier bad than good go."""
    return keep_by_quality(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word-shingle similarity 0.8 stays."""
    return keep_first_of_each(docs, 5, 80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix and their places in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("ngram_join", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Learned models and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
