"""Seeded samples per class that merge: the least k digests, found from counts of digest buckets.

A class's rows are counted by the leading bits of a seeded digest; the counts say in which bucket the k-th row lies, and only
rows up to that bucket, about k of them, are ranked. No task sees a whole class. The same key is always in or out, whatever
the partitions, and the sample of k holds that of any smaller k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.operators.ranges import joined_on, numbered

#: Hexadecimal digits of the digest that name a bucket: 65,536 buckets a class.
BUCKET_DIGITS = 4


def digest(key: Column, seed: int) -> Column:
    """The order in which keys are taken: MD5 of seed and key, as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def bottom_k(df: DataFrame, k: int, by: list[str], key: str, seed: int = 0) -> DataFrame:
    """``k`` rows of each ``by`` (all where it has fewer): those of the least digests of ``key``, which should be unique; 0 means all rows. [A13, F6, F10, D3]

    Rows of equal key are equally likely and all rank next to each other; a null ``by`` is a class of its own.
    """
    if k == 0:
        return df
    marked = df.withColumn("_digest", digest(F.col(key), seed)).withColumn("_bucket", F.left("_digest", F.lit(BUCKET_DIGITS)))
    counts = marked.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # 65,536 rows a class at most
    last = counts.withColumn("_before", before).filter(F.col("_before") < k).groupBy(*by).agg(F.max("_bucket").alias("_last"))
    near = joined_on(marked, last, by).filter(F.col("_bucket") <= F.col("_last"))
    return near.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy("_digest", key))).filter(F.col("_rank") <= k).select(*df.columns)


def first_k(df: DataFrame, k: int, by: list[str], order: list[str]) -> DataFrame:
    """The first ``k`` rows of each ``by`` in ``order``, which should be total. [F7]"""
    return numbered(df, order, by, "_place").filter(F.col("_place") < k).drop("_place")
