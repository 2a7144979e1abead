"""Scans over ranges, false discovery on them, and samples that merge, against plain loops."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import stats
from flowloom.operators import ranges, samples


@pytest.fixture(scope="module")
def values(spark):
    """One family holds most rows, so it spans ranges; some values are null, one family is null."""
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 10 else ("b" if i % 20 else None), i, None if i % 7 == 0 else float(rng.integers(0, 50))) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, i long, v double").repartition(9)


def brute(rows, backward):
    out, state = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1], reverse=backward):
        s = state.setdefault(k, {"sum": None, "min": None, "max": None, "last": None})
        if v is not None:
            s["sum"] = v + (s["sum"] or 0)
            s["min"] = v if s["min"] is None else min(v, s["min"])
            s["max"] = v if s["max"] is None else max(v, s["max"])
            s["last"] = v
        out[i] = dict(s)
    return out


@pytest.mark.parametrize("backward", [False, True])
def test_scan(values, backward):
    rows, df = values
    v = F.col("v")
    got = ranges.scan(df, {"sum": ("sum", F.coalesce(v, F.lit(0.0))), "min": ("min", v), "max": ("max", v), "last": ("last", v)}, ["i"], ["k"], backward)
    assert got.columns == ["k", "i", "v", "sum", "min", "max", "last"]
    want = brute(rows, backward)
    for r in got.collect():
        assert {n: r[n] for n in ("min", "max", "last")} == {n: want[r["i"]][n] for n in ("min", "max", "last")}
        assert r["sum"] == pytest.approx(want[r["i"]]["sum"] or 0)
    assert got.count() == len(rows)


def test_scan_without_groups_and_rows(spark):
    df = spark.createDataFrame([(3, 1), (1, 5), (2, None)], "i int, v int")
    got = ranges.scan(df, {"m": ("min", F.col("v")), "next": ("last", F.col("v"))}, ["i"], backward=True).collect()
    assert {r["i"]: (r["m"], r["next"]) for r in got} == {3: (1, 1), 2: (1, 1), 1: (1, 5)}
    assert ranges.scan(df.filter("i > 9"), {"m": ("max", F.col("v"))}, ["i"]).count() == 0


def test_false_discovery_of_one_hot_family(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 50 else "small", i, None if i % 11 == 0 else float(rng.integers(0, 400)) / 400) for i in range(2000)]
    got = {r["i"]: r["q"] for r in stats.false_discovery(spark.createDataFrame(rows, "f string, i long, p double").repartition(8), "p", ["f"], "i").collect()}
    assert len(got) == 2000
    for family in ("hot", "small"):
        known = sorted((p, i) for f, i, p in rows if f == family and p is not None)
        least = 1.0
        for rank, (p, i) in reversed(list(enumerate(known, 1))):
            least = min(least, p * len(known) / rank)
            assert got[i] == pytest.approx(least)
    assert all(got[i] is None for _, i, p in rows if p is None)


def test_bottom_k(spark):
    rows = [("hot" if i % 30 else ("b" if i % 60 else None), i) for i in range(4000)] + [("few", 9001), ("few", 9002)]
    df = spark.createDataFrame(rows, "cls string, eid long")

    def want(k, seed):
        order = lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
        return {(c, i) for c in ("hot", "b", None, "few") for i in sorted((i for d, i in rows if d == c), key=order)[:k]}

    for k, seed in ((10, 0), (100, 3)):
        got = {(r["cls"], r["eid"]) for r in samples.bottom_k(df.repartition(13), k, ["cls"], "eid", seed).collect()}
        assert got == want(k, seed) == {(r["cls"], r["eid"]) for r in samples.bottom_k(df, k, ["cls"], "eid", seed).collect()}
    assert samples.bottom_k(df, 0, ["cls"], "eid").count() == len(rows)
    assert samples.bottom_k(df.filter("eid < 0"), 5, ["cls"], "eid").count() == 0


def test_first_k(spark):
    df = spark.createDataFrame([("a", 5), ("a", 1), ("a", 3), ("b", 9), (None, 2), (None, 1)], "cls string, eid long")
    got = sorted((str(r["cls"]), r["eid"]) for r in samples.first_k(df, 2, ["cls"], ["eid"]).collect())
    assert got == [("None", 1), ("None", 2), ("a", 1), ("a", 3), ("b", 9)]
