"""A first hop that is taken whole: runs opened last, against samples whose fanout nothing exceeds."""

import pytest

from flowloom.operators import adjacency, sampling
from flowloom.plans.queries import j2_neighbourhood
from tests.test_growth import hub, plan  # noqa: F401  a fixture


@pytest.mark.parametrize("length", [7, 256, 16_384])
def test_whole_neighbours_are_those_of_whole_samples(spark, hub, monkeypatch, length):  # noqa: F811
    """Ties, repeated edges and seeds, an unknown source, time and end, and an end that no edge enters."""
    monkeypatch.setattr(adjacency, "WHOLE_RUN", length)
    edges = hub.union(hub.filter("eid < 30")).union(spark.createDataFrame([(604, 700, None, 3)], hub.schema))
    seeds = hub.filter("eid IN (5, 299, 599, 600, 601, 602, 603)").union(hub.filter("eid = 5")).union(spark.createDataFrame([(299, 40, 3, 0), (None, 90, 0, 77)], hub.schema))
    key = ["seed_eid", "hop", "eid", "src", "dst", "ts"]
    want = sampling.sampled_neighbours(edges, seeds, [1_000_000])
    got = sampling.whole_neighbours(edges, seeds)
    assert dict(got.dtypes) == dict(want.dtypes)
    rows = sorted(map(repr, got.select(key).collect()))
    assert len(rows) > 1500 and rows == sorted(map(repr, want.select(key).collect()))


def test_whole_neighbours_without_edges_or_seeds_are_none(hub):  # noqa: F811
    assert sampling.whole_neighbours(hub, hub.filter("eid < 0")).isEmpty()
    assert sampling.whole_neighbours(hub.filter("eid < 0"), hub).isEmpty()


def test_runs_are_long_and_follow_each_other(hub, monkeypatch):  # noqa: F811
    monkeypatch.setattr(adjacency, "WHOLE_RUN", 50)
    runs = sorted((r.dst, r.first_ts, max(x.ts for x in r.links), len(r.links), r.n) for r in adjacency.whole_runs(hub).collect())
    assert sum(n for *_, n in runs) == 602 and all(size == n <= 50 for *_, size, n in runs)
    assert len([r for r in runs if r[0] == 0]) < 602 / 50 + 8  # about a cut more for each range
    assert all(a[2] <= b[1] for a, b in zip(runs, runs[1:]) if a[0] == b[0])


def test_neighbourhood_meets_long_runs_one_seed_at_a_time(spark, sf_dir):
    """No row a seed and short run is made, and meetings are never broadcast to runs, however few they are."""
    final = plan(j2_neighbourhood(spark, sf_dir)).split("== Physical Plan ==")[1]
    assert "whole-runs" in final and "Generate explode(links" in final.split("Exchange")[0]
    assert "SortMergeJoin [node" in final.split("Exchange")[0] and "Broadcast" not in final.split("Exchange")[0]
