"""A flow's sampled neighbourhood as one row, and games on it: what its edges and its nodes' states add to the logit. [K3-K5, K8, K9, M10]

A row holds at most what the fanouts allow, and rolled-back states come from counters, not from a node's events, so a hot
node costs no more than any other. Games are played in Arrow batches; the states, samples and counters are joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.functions.encode import N_BINS
from flowloom.operators.failures import all_finite, play_each
from flowloom.operators.sampling import sampled_neighbours
from flowloom.operators.shapley import kernel_shap
from flowloom.operators.state import SLICE_WINDOWS, rolling_state, sliced
from flowloom.plans.scratch import written

DIMS = ["is_internal", "novelty", "recency", "in_degree", "out_degree", "unique_dst", "unique_src", "unique_bins", "port_entropy", "in_bytes", "out_bytes", "time_sin", "time_cos", "volume_deviation", "iat_cv"]
NOVELTY, TIME = DIMS.index("novelty"), [DIMS.index("time_sin"), DIMS.index("time_cos")]
#: Fidelity masks, or keeps, this many of the strongest players.
TOP = 3


@dataclass(frozen=True)
class Scorer:
    """Message passing layers (own, near), furthest hop first, and a linear head over both ends; one logit a class.

    States are centred and scaled first, where these are given.
    """

    layers: list[tuple[np.ndarray, np.ndarray]]
    head: np.ndarray
    bias: np.ndarray
    centre: np.ndarray | float = 0.0
    scale: np.ndarray | float = 1.0

    def logits(self, x: np.ndarray, hops: list[np.ndarray], src: int, dst: int) -> np.ndarray:
        """``x``: coalitions x nodes x dims; ``hops``: for each layer a nodes x nodes matrix of in-neighbour means."""
        x = (x - self.centre) / self.scale
        for (own, near), mean in zip(self.layers, hops):
            x = np.maximum(0.0, x @ own.T + (mean @ x) @ near.T)
        return np.concatenate([x[:, src], x[:, dst]], axis=1) @ self.head.T + self.bias


def flow_context(edges: DataFrame, events: DataFrame, seeds: DataFrame, fanouts: list[int], window: int, near: DataFrame | None = None, baselines: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """seed_eid, seed_ts, seed_src, seed_dst, label, links, nodes: the sample and every input node's state at the seed's time. [M10]

    ``seeds``: eid, ts, src, dst, label. ``nodes`` are (node, x, counters) by node; both endpoints are always among them.
    ``near`` is a sample of these seeds that was taken before, ``baselines`` and ``seen`` those of all events where ``events`` are some only.
    """
    ends = seeds.select(F.col("eid").alias("seed_eid"), F.col("ts").alias("seed_ts"), F.col("src").alias("seed_src"), F.col("dst").alias("seed_dst"), "label")
    near = written(sampled_neighbours(edges, seeds, fanouts), "sample") if near is None else near
    links = near.groupBy("seed_eid").agg(F.array_sort(F.collect_list(F.struct("hop", "eid", "src", "dst", "ts"))).alias("links"))
    inputs = near.select("seed_eid", F.explode(F.array("src", "dst")).alias("node")).union(ends.select("seed_eid", F.explode(F.array("seed_src", "seed_dst")).alias("node"))).distinct()
    at = written(inputs.join(ends.select("seed_eid", F.col("seed_ts").alias("ts")), "seed_eid"), "inputs")
    states = rolling_state(events, window, at, baselines, counters=True, seen=seen).select("node", "ts", F.array(*[F.col(d).cast("double") for d in DIMS]).alias("x"), "counters")
    nodes = at.join(states, ["node", "ts"]).groupBy("seed_eid").agg(F.array_sort(F.collect_list(F.struct("node", "x", "counters"))).alias("nodes"))
    return ends.join(links, "seed_eid", "left").join(nodes, "seed_eid")


def rollback_records(context: DataFrame, events: DataFrame, window: int) -> DataFrame:
    """seed_eid, records: both ends' records of each in-window neighbour, with what removing them changes. [C11, K3]

    A record carries its place among its node's events, the times before and after it within the seed's window, and how
    many events its node holds there with the same peer and direction.
    """
    long = window * SLICE_WINDOWS
    players = context.select("seed_eid", "seed_ts", F.explode("links").alias("l")).select("seed_eid", "seed_ts", F.col("l.eid").alias("eid"), F.floor(F.col("seed_ts") / long).alias("slice"), F.col("l.ts").alias("_ts"))
    players = players.filter((F.col("seed_ts") - F.col("_ts") <= window) & (F.col("eid") != F.col("seed_eid"))).drop("_ts").dropDuplicates(["seed_eid", "eid"])
    here = sliced(events.select("node", "ts", "incoming", "bytes", "bin", "peer", "eid"), window)
    in_time = W.partitionBy("node", "slice").orderBy("ts", "eid", "incoming")
    numbered = here.select("*", F.row_number().over(in_time).alias("place"), F.lag("ts").over(in_time).alias("before"), F.lead("ts").over(in_time).alias("after"))
    records = written(players.join(numbered.drop("core"), ["slice", "eid"]), "rollback")
    key = ["node", "slice", "incoming", "peer"]
    asked = records.select(*key, F.col("seed_ts").alias("t")).distinct()
    steps = here.join(asked.select(*key).distinct(), key, "left_semi").select(*key, F.explode(F.array(F.struct(F.col("ts").alias("t"), F.lit(1).alias("n")), F.struct((F.col("ts") + F.lit(window + 1)).alias("t"), F.lit(-1).alias("n")))).alias("s")).select(*key, "s.t", "s.n", F.lit(False).alias("asked"))
    rows = steps.unionByName(asked.select(*key, "t", F.lit(0).alias("n"), F.lit(True).alias("asked")))
    held = rows.withColumn("held", F.sum("n").over(W.partitionBy(*key).orderBy("t").rangeBetween(W.unboundedPreceding, 0))).filter("asked").select(*key, F.col("t").alias("seed_ts"), "held")
    inside = lambda c: F.when(F.col(c).between(F.col("seed_ts") - window, F.col("seed_ts")), F.col(c))
    record = F.struct("node", "place", "eid", "incoming", "ts", inside("before").alias("before"), inside("after").alias("after"), "bytes", "bin", "peer", "held")
    return records.join(held, [*key, "seed_ts"]).groupBy("seed_eid").agg(F.array_sort(F.collect_list(record)).alias("records"))


def _without(x: np.ndarray, counters: dict, records: list, absent: np.ndarray, seed_ts: int, window: int) -> np.ndarray:
    """States (a row a coalition) of one node without its absent records; ``records`` in time order, ``absent`` coalitions x records."""
    d = {name: i for i, name in enumerate(DIMS)}
    out = np.repeat(x[None], len(absent), axis=0)
    weight = absent.astype(float)
    incoming, sizes = np.array([r["incoming"] for r in records]), np.array([r["bytes"] for r in records], dtype=float)
    usual = x[d["in_bytes"]] + x[d["out_bytes"]] - x[d["volume_deviation"]]
    for side, degree, volume in ((incoming, "in_degree", "in_bytes"), (~incoming, "out_degree", "out_bytes")):
        out[:, d[degree]] -= weight @ side
        left = np.maximum(0.0, np.expm1(x[d[volume]]) - weight @ (side * sizes))
        out[:, d[volume]] = np.where(out[:, d[degree]] > 0, np.log1p(left), 0.0)
    out[:, d["novelty"]] = np.where(out[:, d["in_degree"]] + out[:, d["out_degree"]] > 0, x[d["novelty"]], 0.0)
    out[:, d["volume_deviation"]] = out[:, d["in_bytes"]] + out[:, d["out_bytes"]] - usual
    bins = np.array(counters["bins"], dtype=float) - weight @ np.array([[float(not r["incoming"] and r["bin"] == b) for b in range(N_BINS)] for r in records])
    share = bins / np.maximum(bins.sum(axis=1, keepdims=True), 1)
    out[:, d["unique_bins"]] = (bins > 0).sum(axis=1)
    out[:, d["port_entropy"]] = -(share * np.log(np.where(share > 0, share, 1.0))).sum(axis=1)
    for side, peer in {(r["incoming"], r["peer"]) for r in records}:
        same = [i for i, r in enumerate(records) if (r["incoming"], r["peer"]) == (side, peer)]
        out[:, d["unique_src" if side else "unique_dst"]] -= absent[:, same].sum(axis=1) == records[same[0]]["held"]
    gaps, total, squares, last = (np.full(len(absent), float(counters[n] if counters[n] is not None else -np.inf)) for n in ("gaps", "gap_sum", "gap_squares", "last"))
    before = np.full(len(absent), np.nan)
    time = lambda v: np.nan if v is None else float(v)

    def change(start: np.ndarray, end: float, sign: int, where: np.ndarray) -> None:
        gap = end - start
        real = where & ~np.isnan(gap)
        for sums, value in ((gaps, np.ones(len(gap))), (total, gap), (squares, gap * gap)):
            sums[real] += sign * value[real]

    joined = [i > 0 and records[i - 1]["place"] + 1 == r["place"] for i, r in enumerate(records)] + [False]
    for i, r in enumerate(records):
        gone = absent[:, i]
        starts = gone & ~absent[:, i - 1] if joined[i] else gone
        ends = gone & ~absent[:, i + 1] if joined[i + 1] else gone
        before[starts] = time(r["before"])
        change(before, float(r["ts"]), -1, starts)
        change(np.full(len(absent), float(r["ts"])), time(r["after"]), -1, gone)
        change(before, time(r["after"]), 1, ends)
        if r["after"] is None:
            last[ends] = np.where(np.isnan(before[ends]), -np.inf, before[ends])
    mean = total / np.maximum(gaps, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(gaps, 1) - mean * mean, 0.0))
    out[:, d["iat_cv"]] = np.where((gaps > 0) & (total > 0), spread / np.where(mean > 0, mean, 1.0), 0.0)
    out[:, d["recency"]] = np.minimum(1.0, (seed_ts - last) / window)
    return out


def _hops(row, order: dict, depth: int) -> list[np.ndarray]:
    means = []
    for hop in range(depth, 0, -1):
        mean = np.zeros((len(order), len(order)))
        for link in [] if row.links is None else row.links:
            if link["hop"] == hop:
                mean[order[link["dst"]], order[link["src"]]] += 1
        means.append(mean / np.maximum(mean.sum(axis=1, keepdims=True), 1))
    return means


def _fidelity(states: Callable[[np.ndarray], np.ndarray], logits: Callable[[np.ndarray], np.ndarray], phi: np.ndarray, label: int) -> tuple[list[int], float, float]:
    """The strongest players, and the loss of the label's probability without them and with nothing but them."""
    top = sorted(range(len(phi)), key=lambda i: (-abs(phi[i]), i))[:TOP]
    only = np.zeros(len(phi))
    only[top] = 1
    scores = logits(states(np.array([np.ones(len(phi)), 1 - only, only])))
    odds = np.exp(scores - scores.max(axis=1, keepdims=True))
    p = (odds / odds.sum(axis=1, keepdims=True))[:, label]
    return top, round(float(p[0] - p[1]), 6), round(float(p[0] - p[2]), 6)


def neighbour_games(context: DataFrame, records: DataFrame, scorer: Scorer, window: int, samples: int = 1024, errors: bool = False) -> DataFrame:
    """seed_eid, players (eid, ts, phi by falling |phi|), base, value, fidelity_plus, fidelity_minus. [K3, K6, K8]

    An absent edge is rolled back at both of its ends. Without neighbours: no players, 0, 0 and null fidelity.
    With ``errors``, a game that can't be played is a row with its error.
    """

    def play(row) -> tuple:
        if row.records is None:
            return [], 0.0, 0.0, None, None
        order = {n["node"]: i for i, n in enumerate(row.nodes)}
        x, hops = all_finite(np.array([n["x"] for n in row.nodes], dtype=float), list(order)), _hops(row, order, len(scorer.layers))
        eids = sorted({int(r["eid"]) for r in row.records})
        times = {int(r["eid"]): int(r["ts"]) for r in row.records}
        mine = {}
        for r in row.records:
            mine.setdefault(r["node"], []).append(r)

        def states(z: np.ndarray) -> np.ndarray:
            masked = np.repeat(x[None], len(z), axis=0)
            for node, held in mine.items():
                masked[:, order[node]] = _without(x[order[node]], row.nodes[order[node]]["counters"], held, z[:, [eids.index(r["eid"]) for r in held]] == 0, row.seed_ts, window)
            full = z.all(axis=1)
            masked[full] = x
            return masked

        logits = lambda s: scorer.logits(s, hops, order[row.seed_src], order[row.seed_dst])
        phi, base, value = kernel_shap(lambda z: logits(states(z))[:, row.label], len(eids), samples)
        _, plus, minus = _fidelity(states, logits, phi, row.label)
        ranked = sorted(range(len(eids)), key=lambda i: (-abs(phi[i]), i))
        return [{"eid": eids[i], "ts": times[eids[i]], "phi": float(phi[i])} for i in ranked], base, value, plus, minus

    fields = "players array<struct<eid:long,ts:long,phi:double>>, base double, value double, fidelity_plus double, fidelity_minus double"
    return play_each(context.join(records, "seed_eid", "left"), "seed_eid", play, fields, errors)


def label_backgrounds(context: DataFrame) -> DataFrame:
    """label, background: the mean state of the seeds' endpoints by label. [D3]"""
    ends = context.select("label", F.explode(F.filter("nodes", lambda n: (n["node"] == F.col("seed_src")) | (n["node"] == F.col("seed_dst")))).alias("n"))
    means = ends.select("label", F.posexplode("n.x").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("mean"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("background"))


def node_games(context: DataFrame, backgrounds: DataFrame, scorer: Scorer, samples: int = 1024, errors: bool = False) -> DataFrame:
    """seed_eid, phi_src, phi_dst (novelty), nodes (node, phi), n_degenerate, n_dummy, novelty_in_top, base, value, fidelity_plus, fidelity_minus. [K4, K5, K6, K9]

    An absent endpoint's novelty is 0; another node's absent state is its label's background but for the time of day. A
    novelty that is 0 already is degenerate, one that changes no logit with all or with no others present is a dummy; both
    have phi 0 and leave the game. In a self-loop the source's novelty stands for both.
    With ``errors``, a game that can't be played is a row with its error.
    """

    def play(row) -> tuple:
        order = {n["node"]: i for i, n in enumerate(row.nodes)}
        x, hops = all_finite(np.array([n["x"] for n in row.nodes], dtype=float), list(order)), _hops(row, order, len(scorer.layers))
        src, dst = order[row.seed_src], order[row.seed_dst]
        others = [i for i in range(len(x)) if i not in (src, dst)]
        usual = np.repeat(np.asarray(row.background, dtype=float)[None], len(x), axis=0)
        usual[:, TIME] = x[:, TIME]

        def states(z: np.ndarray) -> np.ndarray:
            masked = np.repeat(x[None], len(z), axis=0)
            masked[z[:, 0] == 0, src, NOVELTY] = 0.0
            if dst != src:
                masked[z[:, 1] == 0, dst, NOVELTY] = 0.0
            for k, i in enumerate(others, 2):
                masked[z[:, k] == 0, i] = usual[i]
            return masked

        logits = lambda s: scorer.logits(s, hops, src, dst)
        players = 2 + len(others)
        dead = [e for e, i in enumerate((src, dst)) if x[i, NOVELTY] == 0]
        anchors = []
        for e in (0, 1):
            flipped = np.array([np.ones(players), np.ones(players), np.zeros(players), np.zeros(players)])
            flipped[1, e], flipped[3, e] = 0, 1
            score = logits(states(flipped))[:, row.label]
            anchors.append(score[0] == score[1] and score[2] == score[3])
        dummy = [e for e in (0, 1) if e not in dead and anchors[e]]
        live = [i for i in range(players) if i not in dead and i not in dummy]

        def value(z: np.ndarray) -> np.ndarray:
            whole = np.ones((len(z), players))
            whole[:, live] = z
            return logits(states(whole))[:, row.label]

        phi = np.zeros(players)
        phi[live], base, full = kernel_shap(value, len(live), samples)
        top, plus, minus = _fidelity(states, logits, phi, row.label)
        names = [{"node": int(row.nodes[i]["node"]), "phi": float(phi[k])} for k, i in enumerate(others, 2)]
        return phi[0], phi[1], names, len(dead), len(dummy), sum(i < 2 and abs(phi[i]) > 0 for i in top), base, full, plus, minus

    fields = "phi_src double, phi_dst double, nodes array<struct<node:long,phi:double>>, n_degenerate int, n_dummy int, novelty_in_top int, base double, value double, fidelity_plus double, fidelity_minus double"
    # a row a label
    return play_each(context.join(F.broadcast(backgrounds), "label"), "seed_eid", play, fields, errors)
