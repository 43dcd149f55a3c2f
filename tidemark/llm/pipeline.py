"""Stages over documents: each reads what its predecessor kept; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, group_join, ordinal_toxicity, quality_gbt, sos_packing
from .queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the quality trees; the trees learn from the labels of these documents."""
    return quality_gbt.filter_kept(docs, quality_gbt.learn(docs, common.table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not flag; it learns from the labels of these documents."""
    return ordinal_toxicity.filter_clean(docs, ordinal_toxicity.learn(docs, common.table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates: five words, a similarity of 0.8 or more."""
    return group_join.one_of_each(docs, n=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their places in sequences."""
    return sos_packing.pack(docs, vocabulary("byte_bpe_50k.json"), end=2)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity), ("n-gram Jaccard join", ngram_jaccard_join), ("best-fit packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
