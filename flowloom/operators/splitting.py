"""Chronological splits: thresholds, assignment, coverage, and the sweep over split candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.ranges import joined_on, ranked_values, running
from flowloom.plans.scratch import written


def thresholds(df: DataFrame, train: float, val: float, ts: str = "ts", shift: int = 0) -> DataFrame:
    """One row, n, tau_train, tau_val: the times of rank int(n * share) + shift. [B9, I1]

    ``shift`` 0 and -1 are the two conventions in use. Times are counted first, and ranked over ranges of times.
    """
    ranked = ranked_values(df.select(F.col(ts).alias("t")), "t").withColumnRenamed("total", "n_all").withColumn("n", F.col("n_all"))
    at = lambda share: F.least(F.greatest(F.floor(F.col("n") * F.lit(share)) + shift, F.lit(0)), F.col("n") - 1)
    first = lambda share: F.min(F.when(F.col("upto") > at(share), F.col("t")))
    return ranked.agg(F.max("n").alias("n"), first(train).alias("tau_train"), first(train + val).alias("tau_val"))


def with_split(df: DataFrame, taus: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds split; ties at a cut all fall in the earlier split. [B9]"""
    both = df.join(F.broadcast(taus.select("tau_train", "tau_val")), F.lit(True))  # one row
    split = F.when(F.col(ts) <= F.col("tau_train"), "train").when(F.col(ts) <= F.col("tau_val"), "val").otherwise("test")
    return both.withColumn("split", split).drop("tau_train", "tau_val")


def positional_split(numbered: DataFrame, train: float, val: float, eid: str = "eid") -> DataFrame:
    """The third convention: the first int(n * share) rows by position. [J10]"""
    n = numbered.agg((F.max(eid) + 1).alias("_n"))
    both = numbered.join(F.broadcast(n), F.lit(True))
    a, b = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(train + val))
    return both.withColumn("split", F.when(F.col(eid) < a, "train").when(F.col(eid) < b, "val").otherwise("test")).drop("_n")


def coverage(split: DataFrame, cls: str = "cls") -> DataFrame:
    """Per class its rows in each split, zero-filled, and in how many splits it occurs. [D35]"""
    n = lambda s: F.count_if(F.col("split") == s)
    out = split.groupBy(F.col(cls).alias("cls")).agg(n("train").alias("n_train"), n("val").alias("n_val"), n("test").alias("n_test"))
    return out.withColumn("covered", sum((F.col(c) > 0).cast("int") for c in ("n_train", "n_val", "n_test")))


def never_coverable(cover: DataFrame) -> DataFrame:
    """Classes that some split lacks. [G7]"""
    return cover.filter("covered < 3").select("cls")


def split_sweep(df: DataFrame, trains: list[float], val_share: float, ts: str = "ts", cls: str = "cls") -> DataFrame:
    """For each training share: how many classes occur in all three splits. [I7]

    Rows are counted by (time, class) and summed over ranges once; the row at which a candidate's share is reached names its
    cut, so no row meets all candidates. The cuts, at most two a candidate, cut time into bins; only the counts by class and
    bin meet the candidates.
    """
    spark = df.sparkSession
    counts = written(df.groupBy(F.col(ts).alias("t"), F.col(cls).alias("cls")).agg(F.count("*").alias("c")), "counts")
    every = counts.groupBy("t").agg(F.sum("c").alias("c"))
    upto = joined_on(running(every, F.col("c"), ["t"]), every.agg(F.sum("c").alias("n")), [])
    grid = [(round(t, 6), round(t + (1 - t) * val_share, 6)) for t in trains]
    place = lambda share: F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    reached = F.filter(F.array(*[F.lit(x) for x in sorted({x for pair in grid for x in pair})]), lambda x: (place(x) >= F.col("upto") - F.col("c")) & (place(x) < F.col("upto")))
    cuts = written(upto.select("t", F.explode(reached).alias("share")), "cuts")  # a row a share
    edges = cuts.agg(F.array_sort(F.collect_set("t")).alias("edges"))
    below = lambda t: F.size(F.filter("edges", lambda e: e < t))
    bins = counts.join(F.broadcast(edges), F.lit(True)).groupBy("cls", below(F.col("t")).alias("bin")).agg(F.sum("c").alias("c"))
    at = cuts.join(F.broadcast(edges), F.lit(True)).select("share", below(F.col("t")).alias("at"))
    pairs = spark.createDataFrame(grid, "train double, upto_val double").join(F.broadcast(at.select(F.col("share").alias("train"), F.col("at").alias("a"))), "train")
    pairs = pairs.join(F.broadcast(at.select(F.col("share").alias("upto_val"), F.col("at").alias("b"))), "upto_val")
    per = bins.join(F.broadcast(pairs), F.lit(True)).groupBy("train", "cls").agg(
        F.sum(F.when(F.col("bin") <= F.col("a"), F.col("c"))).alias("x"), F.sum(F.when((F.col("bin") > F.col("a")) & (F.col("bin") <= F.col("b")), F.col("c"))).alias("y"), F.sum(F.when(F.col("bin") > F.col("b"), F.col("c"))).alias("z"),
    )
    return per.groupBy("train").agg(F.count_if((F.col("x") > 0) & (F.col("y") > 0) & (F.col("z") > 0)).alias("covered"), F.count("*").alias("classes"))
