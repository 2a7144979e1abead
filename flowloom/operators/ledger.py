"""Trial ledger: results of a grid search, appended batch by batch, resumed after a stop and promoted only when whole.

``header`` holds the fingerprint of grid and configuration, ``results`` a row per finished trial with the fingerprint it was
made under. What is still to be done is an anti-join of the grid with the results, so a run that stopped anywhere goes on
from what was appended. A batch that is appended twice, by a retry, counts as a fault of promotion only if the two differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import tuning
from flowloom.operators.ranges import gaps
from flowloom.plans.scratch import written
from flowloom.sources.artifacts import fingerprint


def open_ledger(spark: SparkSession, path: str, axes: dict[str, list], config: dict) -> str:
    """The fingerprint of ``axes`` and ``config``, written on the first use of ``path``; ValueError if the ledger was made for others. [J15, A19]"""
    mine = fingerprint({"axes": axes, "config": config})
    try:
        kept = [row["fingerprint"] for row in spark.read.parquet(f"{path}/header").collect()]
    except AnalysisException:  # no such path: a new ledger
        spark.createDataFrame([(mine,)], "fingerprint string").coalesce(1).write.parquet(f"{path}/header")
        return mine
    if kept != [mine]:
        raise ValueError(f"the ledger at {path} was made for another grid or configuration")
    return mine


def results(spark: SparkSession, path: str, mine: str) -> DataFrame:
    """trial, score: the distinct results so far; ValueError if some were made under another fingerprint. [A19]"""
    try:
        rows = spark.read.parquet(f"{path}/results")
    except AnalysisException:
        return spark.createDataFrame([], "trial long, score double")
    stale = rows.filter(~F.col("fingerprint").eqNullSafe(F.lit(mine))).head(1)
    if stale:
        raise ValueError(f"trial {stale[0]['trial']} was made under another grid or configuration")
    return rows.select("trial", "score").distinct()


def append(scored: DataFrame, path: str, mine: str) -> None:
    """Adds trial and score of ``scored`` to the results."""
    scored.select(F.col("trial").cast("long").alias("trial"), F.col("score").cast("double").alias("score"), F.lit(mine).alias("fingerprint")).write.mode("append").parquet(f"{path}/results")


def pending(trials: DataFrame, done: DataFrame) -> DataFrame:
    """The trials without a result. [J15]"""
    return trials.join(done.select("trial").distinct(), "trial", "left_anti")


def run(spark: SparkSession, path: str, axes: dict[str, list], config: dict, evaluate: Callable[[DataFrame], DataFrame], batch: int, batches: int | None = None) -> str:
    """Evaluates what is still to be done, ``batch`` trials at a time, and appends each batch as it ends; returns the fingerprint. [J15]

    ``evaluate`` takes trials (trial, seed and a column per axis; the seed is the configuration's plus the trial's number)
    and returns trial and score for each. ``batches`` ends the run early, as a stop would. A batch that lacks a trial's
    score is an error, so that no run waits for it forever.
    """
    mine = open_ledger(spark, path, axes, config)
    trials = tuning.grid(spark, axes).withColumn("seed", F.col("trial") + int(config.get("seed", 0)))
    left = batches
    while left is None or left > 0:
        now = written(pending(trials, results(spark, path, mine)).orderBy("trial").limit(batch), "batch")  # a batch's size, by definition
        wanted = now.count()
        if not wanted:
            break
        scored = written(evaluate(now).select("trial", "score"), "scored")
        if scored.filter("score IS NOT NULL").join(now, "trial").select("trial").distinct().count() != wanted:
            raise ValueError("a trial of the batch has no score")
        append(scored, path, mine)
        left = None if left is None else left - 1
    return mine


def faults(done: DataFrame, trials: DataFrame) -> DataFrame:
    """fault, first, last: runs of missing trials, foreign trials, and trials with several results, all at once. [G6, J17]"""
    whole = trials.agg(F.min("trial").alias("a"), F.max("trial").alias("b")).first()
    missing = gaps(done, "trial", whole["a"], whole["b"]).select(F.lit("missing").alias("fault"), "first", "last")
    foreign = done.filter(~F.col("trial").between(whole["a"], whole["b"])).select("trial").distinct()
    several = done.groupBy("trial").agg(F.count("*").alias("n")).filter("n > 1")
    one = lambda df, name: df.select(F.lit(name).alias("fault"), F.col("trial").alias("first"), F.col("trial").alias("last"))
    return missing.union(one(foreign, "foreign")).union(one(several, "several results"))


def promote(spark: SparkSession, path: str, axes: dict[str, list], config: dict, points: float, cheapest: dict[str, str] | None = None) -> DataFrame:
    """trial, score, the axes, argmax, in_band, winner: every trial of a whole ledger with what the selection made of it. [J17, F14]

    ValueError that names every fault if the ledger isn't exactly the grid.
    """
    mine = open_ledger(spark, path, axes, config)
    trials, done = tuning.grid(spark, axes), results(spark, path, mine)
    found = [f"{r['fault']} {r['first']}" + (f" to {r['last']}" if r["last"] > r["first"] else "") for r in faults(done, trials).orderBy("first", "fault").limit(100).collect()]
    if found:
        raise ValueError("not promoted: " + "; ".join(found))
    scored = written(trials.join(done, "trial"), "trials")
    best = tuning.select_best(scored).select(F.col("trial").alias("_best"))
    winner = tuning.select_best_in_band(scored, points, axes, cheapest=cheapest).select(F.col("trial").alias("_winner"))
    band = tuning.tie_set(scored, points).select("trial", F.lit(True).alias("_in"))
    rows = scored.join(band, "trial", "left").join(F.broadcast(best), F.lit(True)).join(F.broadcast(winner), F.lit(True))  # one row each
    return rows.select("trial", "score", *axes, (F.col("trial") == F.col("_best")).alias("argmax"), F.coalesce("_in", F.lit(False)).alias("in_band"), (F.col("trial") == F.col("_winner")).alias("winner"))
