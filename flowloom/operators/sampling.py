"""Time-respecting k-hop neighbourhoods: no edge later than what it is sampled for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.adjacency import RUN, draw, eligible, fetched, time_runs, whole_runs
from flowloom.operators.ranges import counts_upto, selected_quantiles
from flowloom.plans.scratch import written


def fronts(seeds: DataFrame) -> DataFrame:
    """seed_eid, node, cutoff: the ends of each seed edge and its time."""
    return seeds.select(F.col("eid").alias("seed_eid"), F.explode(F.array("src", "dst")).alias("node"), F.col("ts").alias("cutoff")).distinct()


def sampled_neighbours(edges: DataFrame, seeds: DataFrame, fanouts: list[int], seed: int = 0) -> DataFrame:
    """seed_eid, hop, eid, src, dst, ts: in-edges of each seed edge's endpoints, hop by hop. [J2, J3, J4, C8, F5]

    The hop nearest the seed takes fanouts[-1]. A node's cutoff is the seed's time at first and then the earliest time of
    the sampled edges that lead to it, kept per seed, so nothing later can enter. All eligible edges are taken up to the
    fanout; of more, as many are drawn by their places in time. The cap is the operator's own parameter. Only drawn edges are
    fetched: a seed never meets all in-edges of a hub. A hop is written only where the next one starts from it, the last one isn't.
    """
    runs = time_runs(edges)
    front = fronts(seeds)
    out = None
    for hop, fanout in enumerate(reversed(fanouts), 1):
        drawn = draw(F.col("p"), fanout, F.lit(seed), F.lit(hop), F.col("seed_eid"), F.col("node"))
        asks = eligible(runs, front).select("seed_eid", "node", "cutoff", "p", drawn.alias("places"))
        taken = fetched(runs, asks).select("seed_eid", F.lit(hop).alias("hop"), "eid", "src", F.col("node").alias("dst"), "ts", "cutoff")
        taken = written(taken, "hop") if hop < len(fanouts) else taken
        out = taken if out is None else out.unionByName(taken)
        front = taken.groupBy("seed_eid", F.col("src").alias("node")).agg(F.min(F.least("cutoff", "ts")).alias("cutoff"))
    return out.drop("cutoff")


#: In-edges that a task of ``whole_neighbours`` holds, about.
TASK_EDGES = 1_000_000


def whole_neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed_eid, hop, eid, src, dst, ts: all in-edges of each seed edge's endpoints up to its time: ``sampled_neighbours`` of one hop without a fanout. [J2]

    An end of a seed meets the long runs that start by its time. Such a meeting is one short row until its run is opened, which
    comes last, without a shuffle and one seed at a time: a broadcast of the meetings would open a run for all of its seeds at once.
    """
    runs = whole_runs(edges)
    asks = fronts(seeds).filter("node IS NOT NULL AND cutoff IS NOT NULL")
    begun = asks.join(runs.select(F.col("dst").alias("node"), "run", "first_ts"), "node").filter("first_ts <= cutoff").select("seed_eid", "node", "run", "cutoff")
    total = runs.agg(F.sum("n")).first()[0] or 0
    parts = max(16 * edges.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_EDGES))  # little is shuffled, many rows come of it
    links = runs.select(F.col("dst").alias("node"), "run", "links").repartition(parts, "node", "run").hint("merge")
    opened = begun.repartition(parts, "node", "run").join(links, ["node", "run"]).select("seed_eid", "node", "cutoff", F.explode("links").alias("_link")).filter("_link.ts <= cutoff")
    return opened.select("seed_eid", F.lit(1).alias("hop"), "_link.eid", "_link.src", F.col("node").alias("dst"), "_link.ts")


def eligible_counts(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed_eid, n: in-edges of the seed's destination up to its own time, ties included. [C8]"""
    asks = seeds.select(F.col("eid").alias("seed_eid"), F.col("dst").alias("node"), F.col("ts").alias("cutoff"))
    return eligible(time_runs(edges), asks).select("seed_eid", F.col("p").alias("n"))


def in_window(neighbours: DataFrame, seeds: DataFrame, window: int) -> DataFrame:
    """Neighbours at most ``window`` before the seed, the seed itself left out, each once per seed. [B10]"""
    t = seeds.select(F.col("eid").alias("seed_eid"), F.col("ts").alias("seed_ts"))
    near = neighbours.join(t, "seed_eid").filter((F.col("seed_ts") - F.col("ts") <= window) & (F.col("eid") != F.col("seed_eid")))
    return near.dropDuplicates(["seed_eid", "eid"])


def window_neighbours(edges: DataFrame, seeds: DataFrame, window: int) -> DataFrame:
    """seed_eid, eid, seed_ts, ts: all in-edges of a seed's ends at most ``window`` before it, as ``in_window`` has them of a whole sample. [B10]

    In a node's time order these are the places from the count of edges before the window to the count up to the seed, so
    only their runs are met, and no pair is shuffled unless ids repeat among edges.
    """
    known = edges.filter("eid IS NOT NULL AND dst IS NOT NULL AND ts IS NOT NULL").select("eid", "src", "dst", "ts")
    runs, long = time_runs(known), F.lit(window + 1)
    until = eligible(runs, fronts(seeds))
    before = eligible(runs, until.select("node", (F.col("cutoff") - long).alias("cutoff")).distinct()).select("node", (F.col("cutoff") + long).alias("cutoff"), F.col("p").alias("low"))
    asks = until.join(before, ["node", "cutoff"], "left").withColumn("low", F.coalesce("low", F.lit(0).cast("long"))).filter("low < p")
    met = asks.withColumn("run", F.explode(F.sequence(F.expr(f"low div {RUN}"), F.expr(f"(p - 1) div {RUN}")))).join(runs.select(F.col("dst").alias("node"), "run", "links"), ["node", "run"])
    first = F.greatest(F.col("low") - F.col("run") * RUN, F.lit(0))
    inside = F.slice("links", (first + 1).cast("int"), (F.least(F.lit(RUN), F.col("p") - F.col("run") * RUN) - first).cast("int"))
    near = met.select("seed_eid", F.col("cutoff").alias("seed_ts"), F.explode(inside).alias("_link")).select("seed_eid", "_link.eid", "seed_ts", "_link.ts").filter("eid <> seed_eid")
    return near if known.groupBy("eid").count().filter("count > 1").isEmpty() else near.distinct()


def gap_seconds(near: DataFrame) -> DataFrame:
    """seed_eid, eid, gap: max((t - ts) / 1000, 0) of distinct neighbours. [I8]"""
    return gaps_of(near).distinct()


def gaps_of(near: DataFrame) -> DataFrame:
    """seed_eid, eid, gap of neighbours that are distinct already. [I8]"""
    return near.select("seed_eid", "eid", F.greatest((F.col("seed_ts") - F.col("ts")) / 1000, F.lit(0.0)).alias("gap"))


def future_edges(edges: DataFrame, window: int, key: str = "dst") -> DataFrame:
    """eid, n_future: edges of the same node with t < ts <= t + window, as a difference of two running counts. [C21]"""
    asks = edges.select("eid", key, F.explode(F.array(F.struct(F.col("ts"), F.lit(-1).alias("sign")), F.struct((F.col("ts") + window).alias("ts"), F.lit(1).alias("sign")))).alias("a")).select("eid", key, "a.ts", "a.sign")
    counted = counts_upto(edges.select(key, "ts"), asks, [key], "ts")
    return counted.groupBy("eid").agg(F.sum(F.col("n") * F.col("sign")).alias("n_future"))


def leaks(neighbours: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row: neighbours, violations (later than their seed), leakage_rate. [I10]"""
    t = seeds.select(F.col("eid").alias("seed_eid"), F.col("ts").alias("seed_ts"))
    return neighbours.join(t, "seed_eid").agg(
        F.count("*").alias("neighbours"), F.count_if(F.col("ts") > F.col("seed_ts")).alias("violations"), F.avg((F.col("ts") > F.col("seed_ts")).cast("double")).alias("leakage_rate"),
    )


def whole_leaks(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``leaks`` of the first hop taken whole, from counts: no row a pair. [I10]

    Such a sample is the first p places of a node's in-edges in time order, p from the runs; those beyond the number of in-edges
    up to the seed's own time, counted on the edges themselves, are later than their seed.
    """
    asks = fronts(seeds)
    own = asks.withColumnRenamed("cutoff", "ts").filter("node IS NOT NULL AND ts IS NOT NULL")
    allowed = counts_upto(edges.filter("dst IS NOT NULL AND ts IS NOT NULL").select(F.col("dst").alias("node"), "ts"), own, ["node"], "ts", "allowed")
    taken = eligible(time_runs(edges), asks).select("seed_eid", "node", F.col("cutoff").alias("ts"), "p")
    both = taken.join(allowed, ["seed_eid", "node", "ts"], "left")
    sums = both.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("neighbours"), F.coalesce(F.sum(F.greatest(F.col("p") - F.coalesce("allowed", F.lit(0)), F.lit(0))), F.lit(0)).alias("violations"))
    return sums.select("neighbours", "violations", F.when(F.col("neighbours") > 0, F.col("violations") / F.col("neighbours")).alias("leakage_rate"))


def window_coverage(gaps_: DataFrame, seeds: DataFrame, windows: list[float]) -> DataFrame:
    """Per window in seconds: seeds with a neighbour within it, share of edges within it, mean per seed, and gap quantiles. [D17, M31, M40]

    ``gaps_`` is read a few times and only counts of it are kept: what is shuffled doesn't grow with its rows.
    """
    n = seeds.agg(F.count("*").alias("seeds"))
    held = [F.count_if(F.col("gap") <= float(w)).alias(f"_n{i}") for i, w in enumerate(windows)]
    each = gaps_.groupBy("seed_eid").agg(F.count("*").alias("_n"), F.min("gap").alias("_least"), *held)
    line = lambda i, w: F.struct(F.lit(float(w)).alias("w"), F.count_if((F.col("_least") <= float(w)) & F.col("seed_eid").isNotNull()).alias("covered"), F.sum(f"_n{i}").alias("edges"))
    whole = each.agg(F.sum("_n").alias("_n"), F.array(*[line(i, w) for i, w in enumerate(windows)]).alias("_lines")).filter("_n > 0")
    per = whole.select("_n", F.explode("_lines").alias("l")).select("l.*", (F.col("l.edges") / F.col("_n")).alias("share"))
    places = selected_quantiles(gaps_, "gap", {"p5": 0.05, "median": 0.5, "p95": 0.95})
    return per.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(places)).select("w", "covered", "seeds", "share", (F.col("edges") / F.col("seeds")).alias("per_seed"), "p5", "median", "p95")
