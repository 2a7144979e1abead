"""Flow contexts and the games on them, against states computed from the events that are left."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import attribution, flow_games, state
from flowloom.operators.shapley import kernel_shap
from flowloom.sources.flows import node_events

WINDOW = 1000


def _scorer(units=3, classes=2):
    rng = np.random.default_rng(1)
    n = len(flow_games.DIMS)
    return flow_games.Scorer([(rng.normal(size=(units, n)), rng.normal(size=(units, n))), (rng.normal(size=(units, units)), rng.normal(size=(units, units)))], rng.normal(size=(classes, 2 * units)), np.zeros(classes))


@pytest.fixture(scope="module")
def flows(spark):
    rng = np.random.default_rng(5)
    # few nodes: repeated pairs, self-loops, and equal times
    rows = [(i, int(t) // 7 * 7 + 20_000, int(rng.integers(4)), int(rng.integers(4)), float(rng.integers(1, 50)), float(rng.integers(1, 50)), int(rng.integers(65536))) for i, t in enumerate(np.sort(rng.integers(0, 4000, 60)))]
    edges = spark.createDataFrame(rows, "eid long, ts long, src long, dst long, in_bytes double, out_bytes double, port int")
    seeds = edges.filter("eid in (0, 17, 40, 59)").select("eid", "ts", "src", "dst", (F.col("eid") % 2).cast("int").alias("label"))
    events = node_events(edges)
    context = flow_games.flow_context(edges, events, seeds, [2, 3], WINDOW).cache()
    return edges, events, context, flow_games.rollback_records(context, events, WINDOW).cache()


def test_rollback_from_counters_equals_recomputed_states(spark, flows):
    edges, events, context, records = flows
    baselines = state.hourly_baselines(events)
    rng = np.random.default_rng(3)
    compared = 0
    for row in context.join(records, "seed_eid").filter("seed_eid in (17, 40, 59)").collect():
        eids = sorted({r["eid"] for r in row["records"]})
        assert all(0 <= row["seed_ts"] - r["ts"] <= WINDOW and r["eid"] != row["seed_eid"] for r in row["records"])
        for absent in ([eids[0]], list(rng.choice(eids, len(eids) // 2 + 1, replace=False)), eids):
            gone = [int(e) for e in absent]
            left = state.rolling_state(events.filter(~F.col("eid").isin(gone)), WINDOW, spark.createDataFrame([(n["node"], row["seed_ts"]) for n in row["nodes"]], "node long, ts long"), baselines=baselines)
            want = {s["node"]: [float(s[d]) for d in flow_games.DIMS] for s in left.collect()}
            for n in row["nodes"]:
                held = [r for r in row["records"] if r["node"] == n["node"]]
                if held:
                    got = flow_games._without(np.array(n["x"]), n["counters"].asDict(), held, np.array([[r["eid"] in gone for r in held]]), row["seed_ts"], WINDOW)[0]
                    assert dict(zip(flow_games.DIMS, got)) == pytest.approx(dict(zip(flow_games.DIMS, want[n["node"]])), abs=1e-6)
                    compared += 1
    assert compared > 6


def test_neighbour_games(flows):
    _, _, context, records = flows
    got = {r["seed_eid"]: r for r in flow_games.neighbour_games(context, records, _scorer(), WINDOW).collect()}
    assert sorted(got) == [0, 17, 40, 59]
    assert (got[0]["players"], got[0]["base"], got[0]["value"], got[0]["fidelity_plus"]) == ([], 0.0, 0.0, None)
    for r in got.values():
        assert sum(p["phi"] for p in r["players"]) == pytest.approx(r["value"] - r["base"], abs=1e-6)
        strength = [abs(p["phi"]) for p in r["players"]]
        assert strength == sorted(strength, reverse=True)
    assert any(abs(p["phi"]) > 1e-9 for r in got.values() for p in r["players"])


def test_node_games(flows):
    _, _, context, _ = flows
    backgrounds = flow_games.label_backgrounds(context)
    rows = {r["seed_eid"]: r for r in context.join(backgrounds, "label").collect()}
    scorer = _scorer()
    for r in flow_games.node_games(context, backgrounds, scorer).collect():
        row = rows[r["seed_eid"]]
        order = {n["node"]: i for i, n in enumerate(row["nodes"])}
        x = np.array([n["x"] for n in row["nodes"]])
        src, dst = order[row["seed_src"]], order[row["seed_dst"]]
        others = [i for i in range(len(x)) if i not in (src, dst)]
        means = [np.zeros((len(x), len(x))) for _ in range(2)]
        for link in row["links"]:
            means[2 - link["hop"]][order[link["dst"]], order[link["src"]]] += 1
        means = [m / np.maximum(m.sum(axis=1, keepdims=True), 1) for m in means]

        def value(present):
            s = x.copy()
            for player in range(2 + len(others)):
                if player in present:
                    continue
                if player < 2:
                    if player == 0 or src != dst:
                        s[(src, dst)[player], flow_games.NOVELTY] = 0
                else:
                    i = others[player - 2]
                    s[i] = [x[i][d] if d in flow_games.TIME else row["background"][d] for d in range(x.shape[1])]
            return scorer.logits(s[None], means, src, dst)[0, row["label"]]

        players = range(2 + len(others))
        orders = list(permutations(players))
        phi = [sum(value({*o[: o.index(p)], p}) - value(set(o[: o.index(p)])) for o in orders) / len(orders) for p in players]
        assert [r["phi_src"], r["phi_dst"], *[n["phi"] for n in r["nodes"]]] == pytest.approx(phi, abs=1e-6)
        assert r["n_degenerate"] == sum(x[i][flow_games.NOVELTY] == 0 for i in (src, dst))
        assert r["n_degenerate"] + r["n_dummy"] <= 2


def test_a_game_of_no_players():
    phi, none, full = kernel_shap(lambda z: np.full(len(z), 2.0), 0)
    assert (len(phi), none, full) == (0, 2.0, 2.0)


def test_novelty_summary(spark):
    rows = spark.createDataFrame([("a", 5, 1, 0.5, 0.25), ("a", 2, 0, 9.0, 9.0), ("a", 4, 0, 0.1, 0.05), ("b", 1, 2, 9.0, 9.0)], "cls string, n_players int, novelty_in_top int, fidelity_plus double, fidelity_minus double")
    got = {r["cls"]: r for r in attribution.novelty_summary(rows, 3).collect()}
    a, b, every = got["a"], got["b"], got[None]
    assert (a["n"], a["with_novelty"], a["n_informative"], a["with_novelty_informative"], a["share_informative"]) == (3, 1, 2, 1, 0.5)
    assert (a["mean_plus"], a["mean_minus"]) == (pytest.approx(0.3), pytest.approx(0.15))
    assert (b["n"], b["with_novelty"], b["n_informative"], b["share_informative"], b["mean_plus"]) == (1, 1, 0, None, None)
    assert (every["n"], every["with_novelty"], every["share"]) == (4, 2, 0.5)
