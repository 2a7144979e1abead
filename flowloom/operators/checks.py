"""Data quality checks as rows (section, name, status, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, section: str, name: str, good, message) -> DataFrame:
    """One row from a one-row ``df``. [M8]"""
    return df.select(F.lit(section).alias("section"), F.lit(name).alias("name"), F.when(good, "PASS").otherwise("FAIL").alias("status"), message.cast("string").alias("message"))


def together(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def split_checks(split: DataFrame) -> DataFrame:
    """Ids in one split each, times in order between splits, sizes. [M2]"""
    ids = split.agg(F.count("*").alias("n"), F.countDistinct("eid").alias("d"))
    t = split.agg(*[f(F.when(F.col("split") == s, F.col("ts"))).alias(f"{s}_{k}") for s in ("train", "val", "test") for k, f in (("a", F.min), ("b", F.max))])
    return together([
        check(ids, "splits", "disjoint", F.col("n") == F.col("d"), F.col("d")),
        check(t, "splits", "train before val", F.col("train_b") < F.col("val_a"), F.col("val_a") - F.col("train_b")),
        check(t, "splits", "val before test", F.col("val_b") < F.col("test_a"), F.col("test_a") - F.col("val_b")),
    ])


def scaling_checks(scaled: DataFrame, column: str) -> DataFrame:
    """Training rows have mean 0 and deviation 1; others needn't. [M7]"""
    m = scaled.agg(F.avg(F.when(F.col("split") == "train", F.col(column))).alias("m"), F.stddev_pop(F.when(F.col("split") == "train", F.col(column))).alias("s"))
    return together([
        check(m, "scaling", "train mean", F.abs("m") < 1e-6, F.round(F.abs("m"), 3)),
        check(m, "scaling", "train deviation", F.abs(F.col("s") - 1) < 1e-6, F.round("s", 3)),
    ])


def one_hot_checks(rows: DataFrame, column: str = "bins") -> DataFrame:
    """Every port array sums to 1. [M4]"""
    bad = rows.agg(F.count_if(F.aggregate(column, F.lit(0.0), lambda a, x: a + x) != 1.0).alias("bad"))
    return check(bad, "encoding", "ports sum to one", F.col("bad") == 0, F.col("bad"))


def balance_checks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Balanced ids come from the training rows, and every original stays. [M6]"""
    foreign = after.select("eid").distinct().join(before, "eid", "left_anti").agg(F.count("*").alias("n"))
    lost = before.select("eid").join(after.select("eid").distinct(), "eid", "left_anti").agg(F.count("*").alias("n"))
    return together([check(foreign, "balance", "within train", F.col("n") == 0, F.col("n")), check(lost, "balance", "keeps originals", F.col("n") == 0, F.col("n"))])


def recompute_check(stored: DataFrame, fresh: DataFrame, column: str) -> DataFrame:
    """Largest difference between stored and recomputed values. [M3]"""
    both = stored.select("eid", F.col(column).alias("_a")).join(fresh.select("eid", F.col(column).alias("_b")), "eid")
    worst = both.agg(F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0)).alias("d"))
    return check(worst, "features", "recomputed", F.col("d") <= 1e-4, F.round("d", 6))
