"""The corpus pipeline: classify, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; all but the last
return the columns of documents. ``run`` writes what a stage returns to the shared folder before the next one starts.

Every stage takes an empty table (and returns one), null and empty texts, null ids, repeated rows, very long texts and extra
columns of any name, which it keeps; what it does with them stands at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import decontaminate, jaccard_join, mixing, quality, sharding
from flowloom.plans.scratch import written
from flowloom.plans.session import bounded_batches


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go.

    Null and empty texts are scored as one empty line; equal texts have equal scores, so repeated rows stay or go together;
    without labels of these documents all stay.
    """
    bounded_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.score_column(model, docs["text"]) >= quality.ACCEPT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more.

    It is the one of the smallest doc_id (null last), then text hash; of rows that repeat it, one. Rows without words,
    null or empty, all stay.
    """
    bounded_batches(spark)
    return jaccard_join.one_per_component(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark phrase of ten words (or a whole shorter item) go, with all rows that repeat them.

    Null and empty texts hold none; without a benchmark all stay.
    """
    bounded_batches(spark)
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: a row per document and epoch with the words that the mix takes.

    A null source is a source of its own; repeated rows are taken each by itself; null and empty texts are never taken.
    """
    return mixing.mixed_documents(docs, block_words=128)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot. Null texts have size 1; repeated rows have places of their own."""
    return sharding.shard_rows(docs, shards=8)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: A trained field can't be written in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
