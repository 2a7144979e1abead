"""Time-sorted adjacency, counts up to a time and draws of places, against plain loops."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import adjacency, ranges, sampling

EDGE = "eid long, src long, dst long, ts long"


@pytest.fixture(scope="module")
def hub(spark):
    """Half of all edges lead to node 0; many of them at equal times."""
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(1, 40)), 0 if i % 2 else int(rng.integers(1, 40)), int(rng.integers(0, 500)) * 10) for i in range(6000)]
    edges = spark.createDataFrame(rows, EDGE)
    return rows, edges, adjacency.time_runs(edges)


def test_runs_hold_every_edge_once_in_time_order(hub):
    rows, _, runs = hub
    got = runs.collect()
    assert max(len(r["links"]) for r in got) == adjacency.RUN  # the hub is many rows of one size
    for node in {r[2] for r in rows}:
        mine = [x for r in sorted((r for r in got if r["dst"] == node), key=lambda r: r["run"]) for x in r["links"]]
        assert [(x["ts"], x["eid"], x["src"]) for x in mine] == sorted((t, e, s) for e, s, d, t in rows if d == node)


def test_eligible_counts_with_ties_before_and_after(spark, hub):
    rows, _, runs = hub
    asks = [(n, t) for n in (0, 1, 7, 99) for t in (-1, 0, 10, 2495, 2500, 4990, 9999)]
    df = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(asks * 2)], "ask long, node long, cutoff long")
    got = {r["ask"]: r["p"] for r in adjacency.eligible(runs, df).collect()}
    want = {i: sum(d == n and t <= cut for _, _, d, t in rows) for i, (n, cut) in enumerate(asks * 2)}
    assert got == {i: p for i, p in want.items() if p}


def test_draws_are_distinct_fair_and_repeatable(spark):
    df = spark.range(4000).select("id", adjacency.draw(F.lit(7).cast("long"), 3, F.col("id")).alias("at"), adjacency.draw(F.lit(3).cast("long"), 3, F.col("id")).alias("all"))
    got = df.collect()
    assert all(len(set(r["at"])) == 3 and max(r["at"]) < 7 and min(r["at"]) >= 0 and r["all"] is None for r in got)
    assert got == df.collect()
    sets = Counter(tuple(sorted(r["at"])) for r in got)
    assert len(sets) == 35  # every set of three of seven
    assert sum((n - 4000 / 35) ** 2 / (4000 / 35) for n in sets.values()) < 66  # chi-squared, 34 degrees of freedom, p about 0.001


def test_capped_sample_of_a_hub(hub):
    rows, edges, runs = hub
    seeds = edges.filter("eid IN (5001, 5003, 17)")
    got = sampling.sampled_neighbours(edges, seeds, [4, 6]).collect()
    time, by_seed = {e: t for e, _, _, t in rows}, {e: (s, d, t) for e, s, d, t in rows}
    for seed in (5001, 5003, 17):
        first = [r for r in got if r["seed_eid"] == seed and r["hop"] == 1]
        for node in set(by_seed[seed][:2]):
            mine = [r["eid"] for r in first if r["dst"] == node]
            assert len(set(mine)) == len(mine) == min(6, sum(d == node and t <= time[seed] for _, _, d, t in rows))
        cutoff = {}
        for r in first:
            cutoff[r["src"]] = min(cutoff.get(r["src"], time[seed]), r["ts"])
        second = [r for r in got if r["seed_eid"] == seed and r["hop"] == 2]
        for node, cut in cutoff.items():
            mine = [r for r in second if r["dst"] == node]
            assert len(mine) == min(4, sum(d == node and t <= cut for _, _, d, t in rows)) and all(r["ts"] <= cut for r in mine)
    assert all(by_seed[r["eid"]] == (r["src"], r["dst"], r["ts"]) for r in got)


def test_edges_without_time_or_end_and_no_edges(spark):
    edges = spark.createDataFrame([(1, 2, 3, 10), (2, 2, None, 10), (3, 2, 3, None), (4, None, 3, 5)], EDGE)
    got = sampling.sampled_neighbours(edges, edges.filter("eid = 1"), [5])
    assert sorted((r["eid"], r["src"]) for r in got.collect()) == [(1, 2), (4, None)]
    none = edges.filter("eid < 0")
    assert sampling.sampled_neighbours(none, none, [2, 2]).count() == 0
    assert sampling.eligible_counts(none, none).count() == 0


def test_counts_upto(spark):
    points = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), (None, 2)], "k string, t long")
    asks = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "a", 1), (4, "a", 9), (5, "b", 9), (6, None, 2)], "i long, k string, t long")
    assert {r["i"]: r["n"] for r in ranges.counts_upto(points, asks, ["k"], "t").collect()} == {1: 0, 2: 2, 3: 2, 4: 3, 5: 0, 6: 1}
