"""Class weights, over- and undersampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.operators.ranges import joined_on, numbered


def class_counts(df: DataFrame, label: str, classes: int) -> DataFrame:
    """label, n for every class 0 to classes - 1, zero-filled. [D5]"""
    dim = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    got = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    return dim.join(got, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def class_weights(df: DataFrame, label: str, classes: int, method: str = "effective_num", beta: float = 0.9999, clamp: float | None = None) -> DataFrame:
    """label, n, weight: weights sum to the number of classes that occur, 0 for others; the clamp comes last. [D4]"""
    if method == "effective_num" and not 0 <= beta < 1:
        raise ValueError("beta must be below 1")
    if df.filter((F.col(label) >= classes) | (F.col(label) < 0)).limit(1).count():
        raise ValueError("a label is out of range")
    n = F.col("n")
    raw = {"effective_num": (1 - beta) / (1 - F.pow(F.lit(beta), n)), "inverse_freq": 1 / n, "sqrt_inverse_freq": 1 / F.sqrt(n)}[method]
    weighed = class_counts(df, label, classes).withColumn("raw", F.when(n > 0, raw))
    whole = W.partitionBy()
    out = weighed.withColumn("weight", F.coalesce(F.col("raw") * F.sum((n > 0).cast("int")).over(whole) / F.sum("raw").over(whole), F.lit(0.0))).drop("raw")
    return out.withColumn("weight", F.least(F.col("weight"), F.lit(float(clamp)))) if clamp else out


def _order(eid: str, seed: int):
    return F.xxhash64(F.lit(seed), F.col(eid))


def oversample(df: DataFrame, label: str, ratio: float, eid: str = "eid", seed: int = 0) -> DataFrame:
    """All rows, and of each class below ceil(largest * ratio) repeats up to that count. [F11]

    A class's repeats go round its rows, ceil or floor of the needed share each: which rows get one more is decided by a hash
    of the row. Classes are ranked over ranges of hashes, so a large one is spread, and nothing is drawn on the driver.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    goal = counts.select(label, "_n", F.ceil(F.max("_n").over(W.partitionBy()) * F.lit(ratio)).alias("_goal"))
    short = joined_on(numbered(df.withColumn("_hash", _order(eid, seed)), ["_hash", eid], [label], "_rank"), goal, [label]).withColumn("_need", F.greatest(F.col("_goal") - F.col("_n"), F.lit(0)))
    whole, rest = F.expr("_need div _n"), F.expr("_need % _n")
    copies = (1 + whole + F.when(F.col("_rank") < rest, 1).otherwise(0)).cast("int")
    return short.withColumn("_copies", F.explode(F.array_repeat(F.lit(0), copies))).select(*df.columns)


def undersample(df: DataFrame, label: str, majority: int, ratio: float, eid: str = "eid", seed: int = 0) -> DataFrame:
    """The majority class cut to int(ratio * others), by hash order. [F12]"""
    others = df.filter(F.col(label) != majority).agg(F.floor(F.count("*") * F.lit(ratio)).alias("_most"))
    many = numbered(df.filter(F.col(label) == majority).withColumn("_hash", _order(eid, seed)), ["_hash", eid], name="_rank")
    kept = many.join(F.broadcast(others), F.lit(True)).filter("_rank < _most").select(*df.columns)
    return df.filter((F.col(label) != majority) | F.col(label).isNull()).unionByName(kept)


def hybrid(df: DataFrame, label: str, majority: int, under: float, over: float, eid: str = "eid", seed: int = 0) -> DataFrame:
    """Undersampling, then oversampling. [F12]"""
    return oversample(undersample(df, label, majority, under, eid, seed), label, over, eid, seed)
