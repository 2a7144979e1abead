"""Irregular histogram bins, split support, runs and gaps of numbers, against numpy and plain loops."""

import math

import numpy as np
import pytest

from flowloom.operators import ranges, timedist

HOUR = 3_600_000


def edges_of(hours_span, bin_seconds, most, extra):
    hours = max(1, math.ceil(hours_span))
    per = round(3600 / bin_seconds)
    if hours * per > most:
        per = max(1, most // hours)
    edges = [i / per for i in range(hours * per + 1)]
    for x in extra:
        if 0 < x < hours and min(abs(e - x) for e in edges) > 0.5e-6 / per:
            edges = sorted([*edges, x])
    return np.array(edges), per


@pytest.mark.parametrize("bin_seconds,most,extra", [(60, 10_000, []), (60, 300, [0.5, 3.37, 3.37, 6.6, 99.0, -1.0]), (700, 5, [2.0, 2.01]), (1, 3, [1.1])])
def test_fine_histogram(spark, bin_seconds, most, extra):
    rng = np.random.default_rng(5)
    elapsed = np.unique(np.concatenate([rng.integers(0, 7 * HOUR, 3000), np.arange(0, 7 * HOUR + 1, HOUR // 60), [round(x * HOUR) for x in extra if 0 < x < 7]]))
    rows = [("ab"[int(v) % 2], int(v) + 1_000_003) for v in elapsed]
    df = spark.createDataFrame(rows + [("a", None)], "cls string, ts long")
    grid = timedist.fine_grid(df, spark.createDataFrame([(extra,)], "extra_h array<double>"), bin_seconds, most)
    edges, per = edges_of(7.0, bin_seconds, most, extra)
    said = grid.first()
    assert (said["per_hour"], said["bins"]) == (per, len(edges) - 1)
    got = timedist.fine_histogram(df, grid).collect()
    for c in "ab":
        want, _ = np.histogram([(t - 1_000_003) / HOUR for k, t in rows if k == c], bins=edges)
        assert {r["bin"]: r["n"] for r in got if r["cls"] == c} == {i: n for i, n in enumerate(want.tolist()) if n}
    for r in got:
        assert (r["start_h"], r["end_h"]) == (edges[r["bin"]], edges[r["bin"] + 1])


def test_fine_histogram_of_one_time_and_of_none(spark):
    none = spark.createDataFrame([(None,)], "extra_h array<double>")
    one = spark.createDataFrame([("a", 5), ("a", 5)], "cls string, ts long")
    assert [tuple(r) for r in timedist.fine_histogram(one, timedist.fine_grid(one, none, 1800)).collect()] == [("a", 0, 0.0, 0.5, 2)]
    empty = one.limit(0)
    assert timedist.fine_histogram(empty, timedist.fine_grid(empty, none)).collect() == []


def test_split_support_counts_ties(spark):
    df = spark.createDataFrame([("a", t) for t in (1, 2, 2, 3, 4, 4, 5)] + [("b", 4)], "cls string, ts long")
    got = {r["cls"]: tuple(r)[1:] for r in timedist.split_support(df, spark.createDataFrame([(2, 4)], "tau_train long, tau_val long")).collect()}
    assert got == {"a": (7, 3, 3, 1, 2, 2), "b": (1, 0, 1, 0, 0, 1)}


@pytest.mark.parametrize("values", [[], [3], [0, 1, 2, 9], [5, 5, 6, 8, 9, 14, -3, None], list(range(0, 400, 3)) + list(range(100, 200))])
def test_islands_and_gaps(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    have, runs = sorted({v for v in values if v is not None}), []
    for v in have:
        if runs and runs[-1][1] == v - 1:
            runs[-1][1] = v
        else:
            runs.append([v, v])
    assert sorted(map(tuple, ranges.islands(df, "v").collect())) == [(a, b, b - a + 1) for a, b in runs]
    missing = []
    for v in range(0, 12):
        if v not in have:
            if missing and missing[-1][1] == v - 1:
                missing[-1][1] = v
            else:
                missing.append([v, v])
    assert sorted(map(tuple, ranges.gaps(df, "v", 0, 11).collect())) == [(a, b, b - a + 1) for a, b in missing]
