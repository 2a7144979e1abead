"""What a query keeps or shuffles grows with its input, not with its pairs."""

import pytest

from flowloom.operators import ranges, reports, sampling, shapley, state


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def hub(spark):
    """A hub of 600 in-edges, three of one time, and two seeds; the second starts where it ends."""
    rows = [(i, 10 * (i // 3), i % 7 + 1, 0) for i in range(600)] + [(600, 1500, 0, 0), (601, 1500, 3, 0), (602, None, 3, 0), (603, 5, 3, None)]
    return spark.createDataFrame(rows, "eid long, ts long, src long, dst long")


def pairs(edges, seeds, window):
    rows, asked = edges.collect(), seeds.collect()
    return sorted({(s.eid, e.eid, s.ts - e.ts) for s in asked for e in rows if e.dst in (s.src, s.dst) and e.dst is not None and e.ts is not None and 0 <= s.ts - e.ts <= window and e.eid != s.eid})


def test_window_neighbours_meet_only_the_window(spark, hub):
    seeds = hub.filter("eid IN (5, 299, 599, 600, 601)")
    for window in (0, 40, 900, 10_000):
        near = sampling.window_neighbours(hub, seeds, window)
        got = sorted((r.seed_eid, r.eid, r.seed_ts - r.ts) for r in near.collect())
        assert got == pairs(hub, seeds, window)
    final = plan(sampling.gaps_of(near)).split("== Physical Plan ==")[1]
    assert "Generate" in final.split("Exchange")[0]  # pairs come last: none is shuffled


def test_window_neighbours_of_repeated_ids_are_distinct(spark, hub):
    twice = hub.union(hub.filter("eid < 30"))
    seeds = hub.filter("eid IN (5, 299)").union(hub.filter("eid = 5"))
    got = sorted((r.seed_eid, r.eid, r.seed_ts - r.ts) for r in sampling.window_neighbours(twice, seeds, 900).collect())
    assert got == pairs(hub, seeds, 900)


def test_whole_leaks_are_counted_without_pairs(spark, hub):
    seeds = hub.filter("eid IN (5, 299, 599, 600, 601)")
    want = sampling.leaks(sampling.sampled_neighbours(hub, seeds, [1_000_000]), seeds).first()
    found = sampling.whole_leaks(hub, seeds)
    assert found.first().asDict() == want.asDict()
    assert "Generate explode(links" not in plan(found)
    none = sampling.whole_leaks(hub, hub.filter("eid < 0")).first()
    assert (none.neighbours, none.violations, none.leakage_rate) == (0, 0, None)


def test_selected_quantiles_are_exact(spark):
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    for rows in ([(float(i * i % 977),) for i in range(2000)], [(3.0,)] * 7, [(1.0,), (None,), (1e9,)], [(0.25,)], []):
        df = spark.createDataFrame(rows, "v double")
        want = ranges.quantiles(df, "v", shares).first().asDict()
        for cuts in (1, 5, 4096):
            assert ranges.selected_quantiles(df, "v", shares, cuts).first().asDict() == pytest.approx(want)


def test_rank_correlations_need_no_key(spark):
    """Repeated rows count each; a null is left out of its column's pairs; a side that is constant where both are known has no rho."""
    rows = [(float(i % 7), float(-(i * i) % 11), None if i % 3 else float(i % 5), 2.0, 1.0 if i % 3 else float(i)) for i in range(90)] * 2
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    want = df.toPandas().rank().corr()
    got = {(r.x, r.y): r.rho for r in reports.rank_correlations(df, names).collect()}
    assert len(got) == 10
    for (x, y), rho in got.items():
        assert rho is None if want[x][y] != want[x][y] else rho == pytest.approx(want[x][y], abs=1e-9)
    assert got["a", "d"] is None and got["a", "c"] is not None


def test_connected_top_k_takes_many_seeds_a_batch(spark):
    """Two seeds of one batch: an edge given twice counts once, unknown strengths come last, edges without ends are skipped."""
    edges = [(10, 1, 2, 0.1), (11, 2, 3, -0.9), (11, 2, 3, -0.9), (12, 7, 8, 1.0), (13, 3, 4, None), (14, None, 1, 2.0), (15, 4, 7, 0.05)]
    rows = [(s, *e, s, 99) for s in (1, 7) for e in edges]
    df = spark.createDataFrame(rows, "seed_eid long, eid long, src long, dst long, phi double, seed_src long, seed_dst long")
    found = shapley.connected_top_k(df, 4)
    got = {s: [r.eid for r in sorted(found.collect(), key=lambda r: r.place) if r.seed_eid == s] for s in (1, 7)}
    assert got == {1: [10, 11, 13, 15], 7: [12, 15, 13, 11]}
    assert "FlatMapGroupsInPandas" not in plan(found)


def test_snapshots_come_without_a_shuffle_of_marks(spark):
    """Every tenth edge is a mark; marks of one time, nodes that come later, idle nodes and an unknown node."""
    flows = [(i, 7 * (i // 15), i % 4 if i < 40 else 9, i % 3) for i in range(90)] + [(90, 100, None, 2), (99, 500, 1, 2)]
    edges = spark.createDataFrame(flows, "eid long, ts long, src long, dst long")
    ends = [(s, t, False, e) for e, t, s, _ in flows] + [(d, t, True, e) for e, t, _, d in flows]
    events = spark.createDataFrame(ends, "node long, ts long, incoming boolean, eid long")
    found = state.snapshot_degrees(events, edges, 10, 20)
    want = set()
    for e, t, _, _ in flows:
        if e % 10 == 9:
            for n in {n for n, at, _, _ in ends if at <= t}:
                inside = [i for m, at, i, _ in ends if n is not None and m == n and t - 20 <= at <= t]
                want.add((e, n, sum(inside), len(inside) - sum(inside)))
    got = found.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    final = plan(found).split("== Physical Plan ==")[1]
    assert "Generate" in final.split("Exchange")[0]  # rows of single marks come last


def test_sweeps_are_dealt_by_their_rows(spark, monkeypatch):
    """Ten times the events, ten times the tasks, of one size."""
    events = spark.range(2000).selectExpr("id % 50 AS node", "id * 10 AS ts", "id % 2 = 0 AS incoming", "1.0D AS bytes", "0 AS bin", "id % 7 AS peer", "id AS eid")
    monkeypatch.setattr(state, "SWEEP_ROWS", 20)
    assert state.sweep_parts(events) == 100
    assert state.sweep_parts(events.limit(3)) == spark.sparkContext.defaultParallelism
    for swept in (state.rolling_state(events, 100), state.window_sums(events, [50, 100])):
        assert "slice#" in plan(swept) and ", 100), REPARTITION_BY_NUM" in plan(swept)
        assert swept.select("node", "ts").distinct().count() == 2000
