"""Sweeps and games read only events within reach of what is asked, with the same states."""

import pytest
from pyspark.sql import functions as F

from flowloom.operators import flow_games, state
from flowloom.plans import queries_analysis
from tests.test_growth import plan


@pytest.fixture(scope="module")
def events(spark):
    return spark.range(1500).selectExpr("IF(id % 31 = 0, NULL, id % 11) AS node", "id * 37 % 5003 AS ts", "id % 2 = 0 AS incoming", "id % 5 * 1.0D AS bytes", "CAST(id % 3 AS INT) AS bin", "id % 7 AS peer", "id AS eid").cache()


@pytest.mark.parametrize("window", [3, 90, 700])
def test_states_are_those_of_all_events(spark, events, monkeypatch, window):
    """Probes at event times and between them, before the first event and after the last, of unknown nodes and times."""
    probes = spark.createDataFrame([(n, t) for n in (0, 3, 77, None) for t in (-50, 0, 37, 1000, 1001, 2600, 9999, None)], "node long, ts long")
    near = state.in_reach(events, probes, window)
    want = events.join(probes.distinct().withColumnsRenamed({"node": "n", "ts": "t"}), F.expr(f"node <=> n AND ts BETWEEN t - {window} AND t"), "left_semi")
    assert want.join(near, "eid", "left_anti").isEmpty() and near.count() < 300 < events.count()
    rows = lambda: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in state.rolling_state(events, window, probes).collect())
    got = rows()
    monkeypatch.setattr(state, "in_reach", lambda events, *_: events)
    assert got == rows() and len(got) > 20


def test_a_sweep_of_probes_reads_their_reach(spark, events):
    probes = spark.createDataFrame([(3, 1000)], "node long, ts long")
    assert "_quarter" in plan(state.rolling_state(events, 90, probes))
    assert "_quarter" not in plan(state.rolling_state(events, 90))


def test_flows_to_fit_on_and_to_explain_are_swept_once(spark, sf_dir, monkeypatch):
    swept = []
    real = flow_games.rolling_state
    monkeypatch.setattr(flow_games, "rolling_state", lambda *a, **k: swept.append(1) or real(*a, **k))
    assert queries_analysis.k4_node_attribution(spark, sf_dir).count() == 10
    assert len(swept) == 1
