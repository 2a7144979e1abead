"""Hand-computed fixtures and properties of the flow operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import encode, stats
from flowloom.operators import attribution, balance, cleaning, graph, metrics, sampling, shapley, splitting, state, timedist, tuning
from flowloom.operators.components import connected_components
from flowloom.operators.ordering import with_eid
from flowloom.sources import artifacts
from flowloom.sources.flows import node_events

EDGES = "eid long, ts long, src long, dst long, in_bytes double, out_bytes double, port int"


@pytest.fixture()
def five(spark):
    rows = [(0, 100, 0, 1, 0.0, 100.0, 80), (1, 200, 0, 2, 0.0, 200.0, 443), (2, 300, 0, 1, 0.0, 150.0, 80), (3, 400, 3, 0, 500.0, 0.0, 9999), (4, 500, 0, 2, 0.0, 300.0, 22)]
    return spark.createDataFrame(rows, EDGES)


def at(spark, events, t, **more):
    probes = spark.createDataFrame([(0, t)], "node long, ts long")
    return state.rolling_state(events, 1000, probes, **more).first()


def test_state_by_hand(spark, five):
    s = at(spark, node_events(five), 600)
    assert (s["novelty"], s["in_degree"], s["out_degree"], s["unique_dst"], s["unique_src"], s["unique_bins"]) == (1, 1, 4, 2, 1, 3)
    assert s["recency"] == pytest.approx(0.1)
    assert s["port_entropy"] == pytest.approx(-(0.5 * math.log(0.5) + 0.5 * math.log(0.25)))
    assert s["in_bytes"] == pytest.approx(math.log1p(500)) and s["out_bytes"] == pytest.approx(math.log1p(750)) and s["iat_cv"] == pytest.approx(0)


def test_rollback_by_hand(spark, five):
    ne = node_events(five)
    gone = spark.createDataFrame([(9, 0, 500, False, 2)], "probe long, node long, ts long, incoming boolean, peer long")
    s = at(spark, state.rolled_back(ne, gone).drop("probe"), 600)
    assert s["recency"] == pytest.approx(0.2) and (s["out_degree"], s["unique_dst"], s["novelty"]) == (3, 2, 1)
    lone = ne.filter("ts = 500 AND node = 0")
    assert at(spark, lone, 600)["novelty"] == 1
    assert at(spark, state.rolled_back(lone, gone).drop("probe"), 600)["novelty"] == 0
    twice = lone.union(lone)
    assert state.rolled_back(twice, gone).count() == 1


def test_no_history_and_noon(spark, five):
    s = state.rolling_state(node_events(five), 1000, spark.createDataFrame([(77, 43_200_000)], "node long, ts long")).first()
    assert (s["novelty"], s["recency"], s["in_degree"], s["out_degree"]) == (0, 1.0, 0, 0)
    assert s["time_sin"] == pytest.approx(0, abs=1e-9) and s["time_cos"] == pytest.approx(-1)
    trained = spark.createDataFrame([(0,)], "node long")
    assert at(spark, node_events(five), 600, trained=trained)["novelty"] == 0


def test_slices_agree_with_one_window(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(t), int(rng.integers(3)), int(rng.integers(3, 6)), 1.0, 2.0, 80) for i, t in enumerate(np.sort(rng.integers(0, 100_000, 300)))]
    ne = node_events(spark.createDataFrame(rows, EDGES))
    got = {(r["node"], r["ts"]): (r["in_degree"], r["out_degree"]) for r in state.rolling_state(ne, 700).collect()}
    every = [(r["node"], r["ts"], r["incoming"]) for r in ne.collect()]
    for (n, t), (i, o) in got.items():
        near = [x for x in every if x[0] == n and t - 700 <= x[1] <= t]
        assert (i, o) == (sum(x[2] for x in near), sum(not x[2] for x in near))


def test_split_ties(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate([0, 1, 2, 3, 4, 5, 5, 5, 8, 9])], "eid long, ts long, cls string")
    taus = splitting.thresholds(rows, 0.5, 0.3)
    assert taus.first()["tau_train"] == 5
    assert splitting.with_split(rows, taus).filter("split = 'train'").count() == 8


def test_eid_is_total(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(500)], "ts long, id long")
    got = with_eid(rows, "ts", ("id",)).orderBy("eid").collect()
    assert [r["eid"] for r in got] == list(range(500)) and [(r["ts"], r["id"]) for r in got] == sorted((i % 7, i) for i in range(500))


def test_ports(spark):
    ports = [80, 443, 53, 22, 20, 25, 3389, 161, 123, 143, 111, 6881, 5190, 0, 1023, 1024, 49151, 49152, 6889]
    want = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 13, 14, 14, 15, 11]
    rows = spark.createDataFrame([(p,) for p in [*ports, -1]], "p int").select("p", encode.port_bin(F.col("p")).alias("b"), encode.one_hot(encode.port_bin(F.col("p")), 16).alias("h"))
    got = {r["p"]: r for r in rows.collect()}
    assert [got[p]["b"] for p in ports] == want and all(sum(got[p]["h"]) == 1 for p in ports) and got[-1]["b"] is None


def test_addresses(spark):
    want = {"10.1.2.3": (True, "private"), "172.16.0.1": (True, "private"), "172.32.0.1": (False, "public"), "192.168.9.9": (True, "private"), "127.0.0.1": (False, "private"), "224.0.0.5": (False, "multicast"), "x": (False, "invalid"), "300.1.1.1": (False, "invalid")}
    rows = spark.createDataFrame([(k,) for k in want], "ip string")
    got = {r[0]: (r[1], r[2], r[3]) for r in rows.select("ip", encode.is_internal_ip(F.col("ip")), encode.ip_type(F.col("ip")), encode.ip_type(F.col("ip"), True)).collect()}
    assert {k: v[:2] for k, v in got.items()} == want and got["127.0.0.1"][2] == "loopback"


def test_cleaning(spark):
    rows = spark.createDataFrame([(1, None, float("inf")), (1, None, float("inf")), (None, 1.0, 2.0), (2, 3.0, 5.0), (3, 4.0, None), (4, 1.0, 9.0)], "k int, a double, b double")
    got = sorted(map(tuple, cleaning.clean(rows, ["k"], ["a"], ["b"]).collect()))
    assert got == [(1, 0.0, 7.0), (2, 3.0, 5.0), (3, 4.0, 7.0), (4, 1.0, 9.0)]
    with pytest.raises(ValueError):
        cleaning.check_label_columns(rows)
    with pytest.raises(ValueError):
        cleaning.require_known_classes(rows.withColumn("c", F.lit("new")), "c", spark.createDataFrame([("old",)], "name string"))


def test_weights(spark):
    rows = spark.createDataFrame([(0,)] * 90 + [(1,)] * 9 + [(3,)], "label int")
    for method in ("effective_num", "inverse_freq", "sqrt_inverse_freq"):
        w = {r["label"]: r["weight"] for r in balance.class_weights(rows, "label", 5, method).collect()}
        assert w[2] == w[4] == 0.0 and sum(w.values()) == pytest.approx(3) and w[3] > w[1] > w[0]
    with pytest.raises(ValueError):
        balance.class_weights(rows, "label", 5, beta=1.0)
    with pytest.raises(ValueError):
        balance.class_weights(rows, "label", 3)


def test_sampling_keeps_originals(spark):
    rows = spark.createDataFrame([(i, 0 if i < 50 else 1 + i % 2) for i in range(70)], "eid long, label int")
    more = balance.oversample(rows, "label", 0.9)
    counts = {r["label"]: r["count"] for r in more.groupBy("label").count().collect()}
    assert counts == {0: 50, 1: 45, 2: 45} and rows.join(more, "eid", "left_anti").count() == 0
    assert balance.undersample(rows, "label", 0, 1.0).filter("label = 0").count() == 20
    assert balance.hybrid(rows, "label", 0, 1.0, 1.0).groupBy("label").count().agg(F.max("count")).first()[0] == 20


FIXTURES = {
    "chain": ([(100, 1), (1, 2), (2, 3)], {100: 0, 1: 1, 2: 2, 3: 3}, {1, 2}),
    "pivot": ([(100, 1), (1, 2)], {100: 0, 1: 1, 2: 2}, {1}),
    "shortcut": ([(100, 1), (100, 2), (1, 2)], {100: 0, 1: 1, 2: 1}, {1}),
    "exfil": ([(100, 1), (1, 200)], {100: 0, 1: 1, 200: 2}, {1}),
    "unreachable": ([(100, 1), (2, 200)], {100: 0, 1: 1}, set()),
}


@pytest.mark.parametrize("name", FIXTURES)
def test_gateway_fixtures(spark, name):
    pairs, want, pivot = FIXTURES[name]
    edges = spark.createDataFrame([(a, b, "x") for a, b in pairs], "src long, dst long, cls string")
    roles = graph.roles(edges, F.col("node") < 100)
    d = graph.gateway_distances(edges, roles)
    assert {r["node"]: r["d"] for r in d.collect()} == want
    assert {r["node"] for r in graph.pivots(edges, roles).filter("cls IS NULL").collect()} == pivot
    assert graph.k_star(d).first()["k_star"] == min(max(want.values()) + 1, 4)


def test_diameters_exact_and_bounded(spark):
    path = [(i, i + 1) for i in range(7)] + [(50, 51)]
    edges = spark.createDataFrame(path, "src long, dst long")
    got = {r["component"]: (r["nodes"], r["links"], r["diameter"], r["exact"]) for r in graph.diameters(edges).collect()}
    assert got == {0: (8, 7, 7, True), 50: (2, 1, 1, True)}
    got = {r["component"]: (r["diameter"], r["exact"]) for r in graph.diameters(edges, most_nodes=4).collect()}
    assert got == {0: (7, False), 50: (1, True)}


def test_components_random(spark):
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 400, (250, 2)).tolist()
    up = list(range(400))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: root(x) for x in nodes}


def test_sampler(spark):
    rows = [(i, 100 * (i + 1), 0, 1, 1.0, 1.0, 80) for i in range(5)] + [(5, 600, 2, 1, 1.0, 1.0, 80), (6, 700, 3, 1, 1.0, 1.0, 80)]
    edges = spark.createDataFrame(rows, EDGES)
    got = sampling.sampled_neighbours(edges, edges.filter("eid = 4"), [10]).collect()
    assert sorted(r["eid"] for r in got) == [0, 1, 2, 3, 4]
    rng = np.random.default_rng(1)
    many = spark.createDataFrame([(i, int(t), int(a), int(b), 1.0, 1.0, 80) for i, (t, a, b) in enumerate(zip(np.sort(rng.integers(1000, 10**6, 2000)), rng.integers(0, 60, 2000), rng.integers(0, 60, 2000)))], EDGES)
    seeds = many.filter("eid % 20 = 3")
    near = sampling.sampled_neighbours(many, seeds, [3, 5])
    assert sampling.leaks(near, seeds).first()["violations"] == 0
    assert near.groupBy("seed_eid", "hop", "dst").count().filter("count > IF(hop = 1, 5, 3)").count() == 0


@pytest.mark.parametrize("players", [2, 5, 11, 14])
def test_shapley_axioms(players):
    w = np.arange(1.0, players + 1)
    w[0] = 0
    phi, none, full = shapley.kernel_shap(lambda z: z @ w + 3, players, 4096)
    assert phi == pytest.approx(w, abs=1e-8) and phi.sum() == pytest.approx(full - none)
    phi, none, full = shapley.kernel_shap(lambda z: np.tanh(z[:, 0] + z[:, 1]) + 0 * z.sum(axis=1), players, 4096)
    assert phi[0] == pytest.approx(phi[1], abs=1e-6) and phi[2:] == pytest.approx(0, abs=1e-6)


def test_degenerate_players(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [1.0, 2.0, 0.0]), (2, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0])], "eid long, x array<double>, background array<double>")
    got = {r["eid"]: r for r in shapley.feature_attribution(rows, [[0, 1], [2]], [1.0, 1.0, 1.0], 0.0).collect()}
    assert got[1]["degenerate"] == 1 and got[1]["phi"][0] == 0.0 and got[1]["phi"][1] == pytest.approx(got[1]["value"] - got[1]["base"])
    assert got[2]["degenerate"] == 2 and got[2]["phi"] == [0.0, 0.0]


def test_fidelity_identities(spark):
    rows = spark.createDataFrame([(1, [1.0, -2.0, 0.5], [0.0, 0.0, 0.0], [1.0, -2.0, 0.5])], "eid long, x array<double>, background array<double>, phi array<double>")
    assert shapley.linear_fidelity(rows, 0, [1.0, 1.0, 1.0], 0.0).first()["fidelity_plus"] == 0.0
    assert shapley.linear_fidelity(rows, 3, [1.0, 1.0, 1.0], 0.0).first()["fidelity_minus"] == 0.0
    tops = spark.createDataFrame([([1.0, -1.0, 0.5],)], "phi array<double>").select(shapley.top_indices(F.col("phi"), 2)).first()[0]
    assert tops == [1, 0]


def test_connected_subgraph(spark):
    rows = [(9, 1, 1, 2, 0.1, 1, 5), (9, 2, 7, 8, 9.0, 1, 5), (9, 3, 2, 7, 0.2, 1, 5), (9, 4, 5, 6, -0.5, 1, 5)]
    got = shapley.connected_top_k(spark.createDataFrame(rows, "seed_eid long, eid long, src long, dst long, phi double, seed_src long, seed_dst long"), 4).orderBy("place").collect()
    assert [r["eid"] for r in got] == [4, 1, 3, 2]


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 0)] * 8 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 2)], "truth int, predicted int")
    m = metrics.summary(rows).first()
    f0, f1 = 2 * 8 / 18, 2 * 3 / 9
    assert m["accuracy"] == pytest.approx(11 / 14) and m["macro_f1"] == pytest.approx((f0 + f1) / 2)
    assert metrics.summary(rows, "union").first()["macro_f1"] == pytest.approx((f0 + f1) / 3)


def test_statistics(spark):
    p = [0.01, 0.04, 0.03, None, 0.2]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(p)], "f int, i int, p double")
    got = {r["i"]: r["q"] for r in stats.false_discovery(rows, "p", ["f"], "i").collect()}
    assert got[3] is None and got[0] == pytest.approx(0.04) and got[1] == got[2] == pytest.approx(0.04 * 4 / 3) and got[4] == pytest.approx(0.2)
    r2 = spark.createDataFrame([(0, float(i), float(i * i)) for i in range(5)] + [(1, 1.0, 2.0), (1, 1.0, 3.0), (1, 1.0, 4.0)], "g int, x double, y double")
    assert {r["g"]: r["rho"] for r in stats.spearman(r2, "x", "y", ["g"]).collect()} == {0: pytest.approx(1.0), 1: None}
    tops = spark.createDataFrame([([1.0, float("nan"), 3.0, 3.0],)], "s array<double>").select(stats.top_k(F.col("s"), 2)).first()[0]
    assert tops == [2, 3]


def test_largest_gap_two_blocks(spark):
    times = [i * 1000 for i in range(50)] + [36_000_000 + 49_000 + i * 1000 for i in range(50)]
    rows = spark.createDataFrame([(t, "x") for t in times], "ts long, cls string")
    g = timedist.largest_gap(rows).first()
    assert (g["gap"], g["zoom_start"]) == (36_000_000, 36_049_000.0)


def test_tuning(spark):
    trials = tuning.grid(spark, {"a": [1, 2], "b": [10, 20, 30]})
    assert [(r["trial"], r["a"], r["b"]) for r in trials.orderBy("trial").collect()] == [(0, 1, 10), (1, 1, 20), (2, 1, 30), (3, 2, 10), (4, 2, 20), (5, 2, 30)]
    with pytest.raises(ValueError):
        tuning.shard_of(trials, "batch_size", [1])


def test_artifacts(spark, tmp_path, five):
    artifacts.save_state(node_events(five), str(tmp_path / "state"), "unseen_in_training")
    assert artifacts.load_state(spark, str(tmp_path / "state"), "unseen_in_training").count() == 10
    with pytest.raises(ValueError):
        artifacts.load_state(spark, str(tmp_path / "state"), "recent_window")
    records = spark.createDataFrame([(1, "DoS", [0.5]), (2, "Benign", [0.1])], "eid long, cls string, phi array<double>")
    artifacts.write_records(records, str(tmp_path / "records"))
    assert sorted(map(str, artifacts.read_records(spark, str(tmp_path / "records"), "eid long, phi array<double>, class_name string").select("eid", "cls", "phi").collect())) == sorted(map(str, records.collect()))
    assert artifacts.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert artifacts.resolve_dataset({"unsw_v3": True, "cse_v3": False}, "uns") == "unsw_v3"
    assert attribution.band(F.lit(0.01), 0.01, 0.025) is not None


def test_lookup_raises(spark, five):
    with pytest.raises(KeyError):
        graph.lookup(spark.createDataFrame([(99,)], "eid long"), five)
    assert graph.lookup(spark.createDataFrame([(1,), (1,)], "eid long"), five).count() == 2
