"""Grid search bookkeeping: trials, shards, merge checks, selection."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """trial and a column per axis: the product in key order, the last axis fastest. [J16]"""
    out = spark.range(1).select(F.lit(0).cast("long").alias("trial"))
    for name, values in axes.items():
        n = len(values)
        out = out.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_i", name)).withColumn("trial", F.col("trial") * n + F.col("_i")).drop("_i")
    return out


def shard_of(trials: DataFrame, axis: str, values: list) -> DataFrame:
    """The trials of some values of one axis; sharding by batch size is refused. [J16]"""
    if axis == "batch_size":
        raise ValueError("batch_size can't be a shard axis")
    return trials.filter(F.col(axis).isin(values))


def grid_fingerprint(axes: dict[str, list]) -> str:
    """[H28]"""
    return hashlib.sha256(json.dumps(axes, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def merge_faults(done: DataFrame, expected: DataFrame) -> DataFrame:
    """trial, fault: missing, foreign and duplicate trials, all at once. [G6, J17]"""
    counts = done.groupBy("trial").agg(F.count("*").alias("n"))
    missing = expected.select("trial").join(counts, "trial", "left_anti").withColumn("fault", F.lit("missing"))
    foreign = counts.select("trial").join(expected, "trial", "left_anti").withColumn("fault", F.lit("foreign"))
    return missing.union(foreign).union(counts.filter("n > 1").select("trial", F.lit("duplicate").alias("fault")))


def select_best(trials: DataFrame, score: str = "score") -> DataFrame:
    """The trial of the largest score, the lowest number on ties. [F14]"""
    return trials.orderBy(F.col(score).desc(), "trial").limit(1)


def tie_set(trials: DataFrame, points: float, score: str = "score") -> DataFrame:
    """The trials within ``points`` percent points of the best score. [F14]"""
    if points < 0:
        raise ValueError(f"a band of {points} points")
    best = trials.agg(F.max(score).alias("_m"))
    return trials.join(F.broadcast(best), F.lit(True)).filter(F.col("_m") - F.col(score) <= points / 100).drop("_m")


def select_best_in_band(trials: DataFrame, points: float, axes: dict[str, list], score: str = "score", cheapest: dict[str, str] | None = None) -> DataFrame:
    """Of the trials within ``points`` percent points of the best, the cheapest on each axis in turn, then of lowest number. [F14]

    ``cheapest`` names the axes to go by, in their order, and which end of each axis is cheap, "first" or "last"; without it
    all axes count, their first values cheap. A trial of the band whose value isn't on its axis is an error.
    """
    order = dict.fromkeys(axes, "first") if cheapest is None else cheapest
    for name, end in order.items():
        if name not in axes or end not in ("first", "last"):
            raise ValueError(f"{name!r}: {end!r} is not an axis with its cheap end, first or last")
    place = {name: F.array_position(F.array(*[F.lit(v) for v in axes[name]]), F.col(name)) for name in order}
    near = tie_set(trials, points, score)
    foreign = [F.coalesce(p, F.lit(0)) == 0 for p in place.values()]
    if foreign and (bad := near.filter(reduce(or_, foreign)).head(1)):
        raise ValueError(f"trial {bad[0]['trial']} has a value that isn't on its axis")
    return near.orderBy(*[p.asc() if order[n] == "first" else p.desc() for n, p in place.items()], "trial").limit(1)
