"""Sums of several windows in one sweep, and games under each of them, against one window at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import ablation, flow_games, sampling, state
from flowloom.sources.flows import node_events

WINDOWS = [1, 2, 9]


@pytest.fixture(scope="module")
def flows(spark):
    """Node 0 has most edges; times tie; windows reach over slices."""
    rng = np.random.default_rng(11)
    rows = [(i, int(t) // 50 * 50 + 900_000, int(rng.integers(4)) * int(rng.integers(2)), int(rng.integers(4)), float(rng.integers(1, 50)), float(rng.integers(1, 50)), int(rng.integers(65536))) for i, t in enumerate(np.sort(rng.integers(0, 400_000, 150)))]
    edges = spark.createDataFrame(rows, "eid long, ts long, src long, dst long, in_bytes double, out_bytes double, port int")
    return rows, edges, node_events(edges).cache()


def brute(events, node, t, w):
    inside = [e for e in events if e["node"] == node and t - w <= e["ts"] <= t]
    inc, out = [e for e in inside if e["incoming"]], [e for e in inside if not e["incoming"]]
    return (len(inc), len(out), len({e["peer"] for e in inc}), len({e["peer"] for e in out}), sum(e["bytes"] for e in inc), sum(e["bytes"] for e in out))


NAMES = ["in_degree", "out_degree", "unique_src", "unique_dst", "in_bytes", "out_bytes"]


def test_window_sums(flows):
    _, _, events = flows
    plain = [r.asDict() for r in events.collect()]
    got = state.window_sums(events, [500, 3000, 70_000]).collect()
    assert len(got) == 3 * len({(e["node"], e["ts"]) for e in plain})
    for r in got:
        assert tuple(r[n] for n in NAMES) == pytest.approx(brute(plain, r["node"], r["ts"], r["window"]))


def test_window_sums_at_probes(spark, flows):
    _, _, events = flows
    plain = [r.asDict() for r in events.collect()]
    probes = spark.createDataFrame([(n, t) for n in (0, 3, 77) for t in (899_999, 950_001, 1_400_000)], "node long, ts long")
    got = {(r["node"], r["ts"], r["window"]): tuple(r[n] for n in NAMES) for r in state.window_sums(events, [3000, 500], probes).collect()}
    assert len(got) == 18
    for (n, t, w), held in got.items():
        assert held == pytest.approx(brute(plain, n, t, w))


def test_window_games_equal_games_of_one_window(spark, flows):
    _, edges, events = flows
    rng = np.random.default_rng(1)
    d = len(flow_games.DIMS)
    scorer = flow_games.Scorer([(rng.normal(size=(3, d)), rng.normal(size=(3, d))), (rng.normal(size=(3, 3)), rng.normal(size=(3, 3)))], rng.normal(size=(2, 6)), np.zeros(2))
    label = (F.col("eid") % 2).cast("int")
    seeds = edges.filter("eid % 4 < 2").select("eid", "ts", "src", "dst", label.alias("label"), F.when(label == 1, "odd").otherwise("even").alias("cls"))
    gaps, games = ablation.window_games(edges, events, seeds, [2, 2], scorer, WINDOWS, per_class=3)
    got = games.collect()
    least, names = {}, {r["eid"]: r["cls"] for r in seeds.collect()}
    for r in gaps.collect():
        least[r["seed_eid"]] = min(r["gap"], least.get(r["seed_eid"], 1e9))
    for w in WINDOWS:
        here = {r["seed_eid"]: r for r in got if r["window"] == w}
        want = [e for c in ("odd", "even") for e in sorted(s for s in least if names[s] == c and least[s] <= w)[:3]]
        assert sorted(here) == sorted(want)
        context = flow_games.flow_context(edges, events, seeds.filter(F.col("eid").isin(want)), [2, 2], w * 1000)
        for r in flow_games.neighbour_games(context, flow_games.rollback_records(context, events, w * 1000), scorer, w * 1000).collect():
            phi = [abs(p["phi"]) for p in r["players"]]
            assert here[r["seed_eid"]]["n_inwindow"] == len(phi) > 0
            assert (here[r["seed_eid"]]["sum_phi"], here[r["seed_eid"]]["top_phi"]) == pytest.approx((sum(phi), max(phi)))
    curve = {r["w"]: r for r in ablation.window_curve(sampling.window_coverage(gaps, seeds, WINDOWS), games).collect()}
    tops = {w: np.mean([r["top_phi"] for r in got if r["window"] == w]) for w in WINDOWS if any(r["window"] == w for r in got)}
    assert curve[9.0]["mean_top"] == pytest.approx(tops[9])
    assert curve[9.0]["delta"] == pytest.approx(tops[9] - tops[2])
    assert curve[9.0]["coverage"] == pytest.approx(100 * sum(v <= 9 for v in least.values()) / seeds.count())
