"""Shapley attribution per edge: kernel regression over coalitions, screens for players that cannot matter, fidelity.

Each game is one group of rows with few players (feature groups, sampled neighbours, or nodes), so a game fits a task by
construction; games are dealt over the cluster by ``groupBy(eid).applyInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.failures import array_fault


def coalitions(players: int, samples: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Coalition rows (without the empty and full ones) and their kernel weights: all if they fit ``samples``, else drawn by size."""
    sizes = np.arange(1, players)
    kernel = (players - 1) / (sizes * (players - sizes))
    if players <= 30 and 2**players - 2 <= samples:
        rows, weights = [], []
        for s, k in zip(sizes, kernel):
            for chosen in combinations(range(players), int(s)):
                row = np.zeros(players)
                row[list(chosen)] = 1
                rows.append(row)
                weights.append(k / comb(players, int(s)))
        return np.array(rows), np.array(weights)
    rng = np.random.default_rng(seed)
    drawn = rng.choice(sizes, size=samples // 2, p=kernel / kernel.sum())
    rows = np.zeros((len(drawn), players))
    for i, s in enumerate(drawn):
        rows[i, rng.choice(players, int(s), replace=False)] = 1
    rows = np.concatenate([rows, 1 - rows])  # each with its complement
    distinct, counts = np.unique(rows, axis=0, return_counts=True)
    return distinct, counts.astype(float)


def kernel_shap(value: Callable[[np.ndarray], np.ndarray], players: int, samples: int = 2048, seed: int = 0) -> tuple[np.ndarray, float, float]:
    """(phi, value of none, value of all): weighted least squares with the sum of phi held at their difference. [K1, K10]"""
    none, full = value(np.zeros((1, players)))[0], value(np.ones((1, players)))[0]
    if players == 0:
        return np.zeros(0), float(none), float(full)
    if players == 1:
        return np.array([full - none]), float(none), float(full)
    z, w = coalitions(players, samples, seed)
    y = value(z) - none - z[:, -1] * (full - none)
    x = z[:, :-1] - z[:, -1:]
    head = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    return np.append(head, full - none - head.sum()), float(none), float(full)


def kernel_shap_many(value: Callable[[np.ndarray], np.ndarray], players: int, samples: int = 2048, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many games of the same players: ``value`` gives a row per game and a column per coalition. [K1, K10]"""
    ends = value(np.array([np.zeros(players), np.ones(players)]))
    none, full = ends[:, 0], ends[:, 1]
    if players < 2:
        return (full - none)[:, None][:, :players], none, full
    z, weight = coalitions(players, samples, seed)
    y = value(z) - none[:, None] - (full - none)[:, None] * z[:, -1]
    root = np.sqrt(weight)
    head = np.linalg.lstsq((z[:, :-1] - z[:, -1:]) * root[:, None], (y * root).T, rcond=None)[0].T
    return np.column_stack([head, full - none - head.sum(axis=1)]), none, full


def live_players(x: Column, background: Column, groups: list[list[int]]) -> Column:
    """Indices of the groups in which a value differs from the background; nulls and NaN keep a group in play. [K2]"""
    same = lambda i: F.coalesce(F.element_at(x, i + 1) == F.element_at(background, i + 1), F.lit(False)) & ~F.isnan(F.element_at(x, i + 1))
    tests = []
    for number, group in enumerate(groups):
        every = F.lit(True)
        for i in group:
            every = every & same(i)
        tests.append(F.when(~F.coalesce(every, F.lit(False)), F.lit(number)))
    return F.filter(F.array(*tests), lambda v: v.isNotNull())


def feature_attribution(rows: DataFrame, groups: list[list[int]], weights: list[float], bias: float, samples: int = 2048, errors: bool = False) -> DataFrame:
    """eid, phi, base, value, degenerate of a linear-logit scorer over (eid, x, background) rows. [K1, K2, K6]

    Groups whose values equal the background's are dead: their phi is exactly 0 and the game is played by the rest.
    With ``errors``, a row whose x or background isn't as many finite numbers as weights has only its eid and the fault in
    ``error``, which is null for the others.
    """
    w = np.array(weights)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            if errors:
                out = [(eid, None, None, None, None, error) for eid, error in zip(batch["eid"], batch["error"]) if error is not None]
                batch = batch[batch["error"].isna()]
            # games with the same live players share coalitions, and are played side by side
            for live, games in batch.groupby(batch["live"].map(tuple)):
                x, bg = np.stack(games["x"].to_numpy()).astype(float), np.stack(games["background"].to_numpy()).astype(float)

                def value(z: np.ndarray, x=x, bg=bg, live=live) -> np.ndarray:
                    part = np.zeros((len(z), x.shape[1]))
                    for k, g in enumerate(live):
                        part[:, groups[g]] = z[:, k : k + 1]
                    return np.tanh((bg[:, None] + part * (x - bg)[:, None]) @ w + bias)

                phi = np.zeros((len(games), len(groups)))
                got, base, full = kernel_shap_many(value, len(live), samples)
                phi[:, list(live)] = got
                out += zip(games["eid"], phi, base, full, [len(groups) - len(live)] * len(games), *([[None] * len(games)] if errors else []))
            yield pd.DataFrame(out, columns=names, dtype=object if errors else None)

    form, names = "eid long, phi array<double>, base double, value double, degenerate int", ["eid", "phi", "base", "value", "degenerate"]
    kept = ["eid", "x", "background", "live"]
    if errors:
        form, names, kept = form + ", error string", [*names, "error"], [*kept, "error"]
        fault = F.coalesce(array_fault(F.col("x"), len(w), "x"), array_fault(F.col("background"), len(w), "background"))
        still = F.array_repeat(F.lit(0.0), len(w))  # in place of what can't be compared
        rows = rows.select("eid", "x", "background", fault.alias("error")).withColumns({c: F.when(F.col("error").isNull(), F.col(c)).otherwise(still) for c in ("x", "background")})
    played = rows.withColumn("live", live_players(F.col("x"), F.col("background"), groups))
    return played.select(*kept).mapInPandas(explain, form)


def connected_top_k(edges: DataFrame, k: int) -> DataFrame:
    """seed_eid, place, eid: greedily the strongest edges that touch what is already chosen. [F13]

    ``edges``: seed_eid, eid, src, dst, phi, and the seed's own endpoints as seed_src, seed_dst. Edges without endpoints are skipped,
    an edge given more than once counts once. A seed's sorted edges are one row, and many seeds are picked from in one batch.
    """
    weaker = F.coalesce(-F.abs("phi"), F.lit(float("nan"))).alias("o")  # unknown ones last
    known = F.when(F.col("src").isNotNull() & F.col("dst").isNotNull(), F.struct(weaker, "eid", "src", "dst"))
    rows = edges.groupBy("seed_eid").agg(F.first("seed_src").alias("seed_src"), F.first("seed_dst").alias("seed_dst"), F.array_sort(F.collect_set(known)).alias("links"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, places, chosen, start = [], [], [], 0
            links = batch.column("links")
            eids, ends = links.flatten().field("eid").to_pylist(), list(zip(links.flatten().field("src").to_pylist(), links.flatten().field("dst").to_pylist()))
            for seed, a, b, n in zip(batch.column("seed_eid").to_pylist(), batch.column("seed_src").to_pylist(), batch.column("seed_dst").to_pylist(), links.value_lengths().to_pylist()):
                free, nodes, taken = list(range(start, start + n)), {a, b}, []
                start += n
                while free and len(taken) < k:
                    found = next((i for i in free if ends[i][0] in nodes or ends[i][1] in nodes), None)
                    if found is None:
                        break
                    taken.append(eids[found])
                    nodes.update(ends[found])
                    free = [i for i in free if eids[i] != eids[found]]
                seeds += [seed] * len(taken)
                places += range(1, len(taken) + 1)
                chosen += taken
            yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(places, pa.int32()), pa.array(chosen, pa.int64())], ["seed_eid", "place", "eid"])

    return rows.mapInArrow(pick, "seed_eid long, place int, eid long")


def top_indices(phi: Column, k: int) -> Column:
    """Indices from 0 of the k largest |phi|, ties to the larger index. [F3]"""
    return F.transform(F.slice(F.reverse(F.array_sort(F.transform(phi, lambda v, i: F.struct(F.abs(v).alias("v"), i.alias("i"))))), 1, k), lambda s: s["i"])


def linear_fidelity(rows: DataFrame, k: int, weights: list[float], bias: float) -> DataFrame:
    """eid, fidelity_plus, fidelity_minus of one-feature groups under a logistic scorer: the top k masked, and only they kept. [K7]"""
    w = F.array(*[F.lit(float(v)) for v in weights])
    top = rows.withColumn("top", top_indices(F.col("phi"), k))
    prob = lambda x: 1 / (1 + F.exp(-(F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + bias)))
    swap = lambda inside: F.zip_with(F.transform("x", lambda v, i: F.struct(v.alias("v"), i.alias("i"))), F.col("background"), lambda s, b: F.when(F.array_contains("top", s["i"]) == F.lit(inside), b).otherwise(s["v"]))
    full = prob(F.col("x"))
    return top.select("eid", F.round(full - prob(swap(True)), 6).alias("fidelity_plus"), F.round(full - prob(swap(False)), 6).alias("fidelity_minus"))


def aligned(stored: DataFrame, fresh: DataFrame, key: str, member: str) -> DataFrame:
    """``key`` groups whose stored and fresh member sets agree; others are skipped. [C12, C13, G9]"""
    a = stored.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("_a"))
    b = fresh.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("_b"))
    return a.join(b, key).filter((F.size(F.array_except("_a", "_b")) == 0) & (F.size(F.array_except("_b", "_a")) == 0)).select(key)
