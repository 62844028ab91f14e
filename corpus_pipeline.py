"""The corpus pipeline: five stages of the training-data operators, each written as Parquet and read again by the next.

Every stage is a function of (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and any other
columns that docs has, whatever their names; the last one adds shard and slot.

Defined results, stage by stage, are those of the operators. In short: a null or empty text is scored like any other (and goes if it is
below the threshold), is no one's near copy, holds no passage, has size 0 and so is never taken by the mix; rows with a null doc_id are
judged by their text and never go as near copies; rows equal in all columns are rows of their own but for the near copies, of which one
stays; ties go by doc_id, then by hashes of the text; texts are taken whole, however long; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobtide.llm import base, decontamination, jaccard, mixing, quality, sharding


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, scored one by one, whatever their other columns hold."""
    return quality.kept(docs, base.load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked at a Jaccard index of 0.8: that of the smallest doc_id. Rows without
    words or doc_id stay."""
    return jaccard.one_each(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows of equal texts go together."""
    return decontamination.clean(docs, base.load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, from none to twice; a null source is a source."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot, rows of equal texts in one shard; nulls are values like any other."""
    return sharding.sharded(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

#: Classifier, components and alignment are not expressible in SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.load(spark, sf_dir, "documents")
    parked = []
    for _, stage in STAGES:
        docs = base.park(stage(spark, docs, sf_dir))
        parked.append(docs)
    base.discard(*parked[:-1])
    return docs
