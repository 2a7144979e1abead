"""How attributions change with the window: the same sampled flows, their neighbours' games under each of several windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.operators.flow_games import Scorer, flow_context, neighbour_games, rollback_records
from flowloom.operators.ranges import numbered
from flowloom.operators.sampling import gap_seconds, sampled_neighbours
from flowloom.operators.state import first_seen, hourly_baselines, in_reach
from flowloom.plans.scratch import written


def first_covered(gaps: DataFrame, seeds: DataFrame, windows: list[int], per_class: int, cls: str = "cls") -> DataFrame:
    """window, cls, seed_eid: of each class the first ``per_class`` seeds by id that have a neighbour within the window (seconds). [I9]"""
    nearest = gaps.groupBy("seed_eid").agg(F.min("gap").alias("_gap"))
    named = nearest.join(seeds.select(F.col("eid").alias("seed_eid"), F.col(cls).alias("cls")), "seed_eid")
    each = named.withColumn("window", F.explode(F.array(*[F.lit(w).cast("long") for w in windows]))).filter(F.col("_gap") <= F.col("window"))
    return numbered(each.select("window", "cls", "seed_eid"), ["seed_eid"], ["window", "cls"], "_k").filter(F.col("_k") < per_class).drop("_k")


def window_games(edges: DataFrame, events: DataFrame, seeds: DataFrame, fanouts: list[int], scorer: Scorer, windows: list[int], per_class: int = 5, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The gaps of all seeds (seed_eid, eid, gap), and window, cls, seed_eid, n_inwindow, sum_phi, top_phi of the first covered seeds. [I9]

    ``seeds``: eid, ts, src, dst, label, cls; windows in seconds. Neighbours are sampled once for all windows. The games need
    states only of nodes near the chosen seeds, ``per_class`` of a class and window, so only these nodes' events in the widest
    window before a chosen seed are kept and swept. ``near`` is a sample of the seeds that was taken before.
    """
    near = written(sampled_neighbours(edges, seeds, fanouts), "sample") if near is None else near
    times = seeds.select(F.col("eid").alias("seed_eid"), F.col("ts").alias("seed_ts"))
    gaps = written(gap_seconds(near.join(times, "seed_eid").filter("eid <> seed_eid")), "gaps")
    chosen = written(first_covered(gaps, seeds, windows, per_class), "chosen")
    mine = written(near.join(chosen.select("seed_eid").distinct(), "seed_eid", "left_semi"), "near")
    ours = seeds.join(chosen.select(F.col("seed_eid").alias("eid")).distinct(), "eid", "left_semi")
    ends = F.explode(F.array("src", "dst")).alias("node")
    probes = mine.join(times, "seed_eid").select(ends, F.col("seed_ts").alias("ts")).union(ours.select(ends, "ts")).distinct()
    local = written(in_reach(events, probes, max(windows) * 1000), "events")
    baselines, seen = written(hourly_baselines(events), "baselines"), written(first_seen(events), "seen")
    played = []
    for w in windows:
        here = chosen.filter(F.col("window") == w)
        some = lambda df, key, here=here: df.join(here.select(F.col("seed_eid").alias(key)), key, "left_semi")
        context = written(flow_context(edges, local, some(ours, "eid"), fanouts, w * 1000, some(mine, "seed_eid"), baselines, seen), "context")
        games = neighbour_games(context, rollback_records(context, local, w * 1000), scorer, w * 1000)
        size = F.transform("players", lambda p: F.abs(p["phi"]))
        total = F.aggregate(size, F.lit(0.0), lambda a, b: a + b)
        played.append(here.join(games.select("seed_eid", F.size("players").alias("n_inwindow"), total.alias("sum_phi"), F.coalesce(F.array_max(size), F.lit(0.0)).alias("top_phi")), "seed_eid"))
    return gaps, reduce(DataFrame.unionByName, played).select("window", "cls", "seed_eid", "n_inwindow", "sum_phi", "top_phi")


def window_curve(coverage: DataFrame, games: DataFrame) -> DataFrame:
    """Per window: w, coverage (percent), p5, median and p95 of the gaps, n_games, mean_top, max_top, and delta of mean_top against the next smaller window. [M31, M40]

    ``coverage``: w, covered, seeds and the gap quantiles. A window without games has null means.
    """
    per = games.groupBy(F.col("window").cast("double").alias("w")).agg(F.count("*").alias("n_games"), F.avg("top_phi").alias("mean_top"), F.max("top_phi").alias("max_top"))
    both = coverage.join(per, "w", "left").withColumn("n_games", F.coalesce("n_games", F.lit(0)))
    return both.select("w", (100.0 * F.col("covered") / F.col("seeds")).alias("coverage"), "p5", "median", "p95", "n_games", "mean_top", "max_top", (F.col("mean_top") - F.lag("mean_top").over(W.orderBy("w"))).alias("delta"))  # a row per window
