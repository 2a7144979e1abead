"""Fitting the edge scorer: the network against the scorer that plays games, its gradient, and whole fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import fitting, flow_games
from flowloom.sources.flows import node_events

WINDOW = 1000
SHAPE = fitting.Shape(depth=2, units=3, classes=2)


@pytest.fixture(scope="module")
def context(spark):
    """The label is whether the flow's source has been busy, which the states tell."""
    rng = np.random.default_rng(8)
    rows = [(i, 20_000 + int(t), int(rng.integers(2) if rng.random() < 0.5 else rng.integers(2, 30)), int(rng.integers(30, 40)), float(rng.integers(1, 50)), float(rng.integers(1, 50)), int(rng.integers(65536))) for i, t in enumerate(np.sort(rng.integers(0, 6000, 400)))]
    edges = spark.createDataFrame(rows, "eid long, ts long, src long, dst long, in_bytes double, out_bytes double, port int")
    seeds = edges.filter("eid >= 100").select("eid", "ts", "src", "dst", F.when(F.col("src") < 2, 1).otherwise(0).alias("label"))
    made = flow_games.flow_context(edges, node_events(edges), seeds, [2, 3], WINDOW)
    return made.withColumn("part", F.when(F.col("seed_eid") % 4 == 0, "val").otherwise("train")).cache()


@pytest.fixture(scope="module")
def rows(context):
    return fitting.packed(context)


def block_of(rows, centre=0.0, scale=1.0):
    table = rows.filter("seed_eid < 140").orderBy("seed_eid").toArrow().combine_chunks()
    block = fitting.Block.of(table.to_batches()[0])
    block.x = (block.x - centre) / scale
    return table, block


def test_forward_equals_the_scorer(context, rows):
    centre, scale = fitting.input_scale(rows)
    weights = SHAPE.start(3) + 0.1
    table, block = block_of(rows, centre, scale)
    p = fitting.forward(SHAPE, weights, block)[0]
    scorer = SHAPE.scorer(weights, centre, scale)
    by_seed = dict(zip(table["seed_eid"].to_pylist(), p))
    for row in context.filter("seed_eid < 140").toPandas().itertuples():
        order = {n["node"]: i for i, n in enumerate(row.nodes)}
        x = np.array([n["x"] for n in row.nodes], dtype=float)
        odds = np.exp(scorer.logits(x[None], flow_games._hops(row, order, 2), order[row.seed_src], order[row.seed_dst])[0])
        assert by_seed[row.seed_eid] == pytest.approx(odds / odds.sum())


def test_gradient_against_finite_differences(rows):
    table, block = block_of(rows, *fitting.input_scale(rows))
    weights, each = SHAPE.start(1) + 0.05, np.linspace(0.5, 2, len(table))
    _, gradient = fitting.loss_and_gradient(SHAPE, weights, block, each)
    for i in np.random.default_rng(0).choice(len(weights), 40, replace=False):
        step = np.zeros_like(weights)
        step[i] = 1e-6
        up, down = (fitting.loss_and_gradient(SHAPE, w, block, each)[0] for w in (weights + step, weights - step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def test_epoch_sums_equal_one_block(rows):
    centre, scale = fitting.input_scale(rows)
    table = rows.toArrow().combine_chunks()
    block = fitting.Block.of(table.to_batches()[0])
    block.x = (block.x - centre) / scale
    weights, each = SHAPE.start(2), np.array([1.0, 3.0])
    train = np.array(table["part"].to_pylist()) == "train"
    loss, gradient = fitting.loss_and_gradient(SHAPE, weights, block, np.where(train, each[block.label], 0))
    sums = fitting._epoch(rows, SHAPE, weights, centre, scale, each)
    assert sums[:2] == pytest.approx([loss, each[block.label][train].sum()], abs=1e-6)
    assert sums[2:-4] == pytest.approx(gradient, abs=1e-6)
    assert sums[-4:].sum() == (~train).sum()


def test_fit_learns_agrees_and_stops(rows):
    got = fitting.fit(rows, 2, [1.0, 1.0], units=3, epochs=30, rate=0.05, patience=6)
    losses, scores = [h[1] for h in got.history], [h[2] for h in got.history]
    assert losses[-1] < 0.7 * losses[0] and max(scores) > 0.8
    again = fitting.fit(rows, 2, [1.0, 1.0], units=3, epochs=30, rate=0.05, patience=6)
    assert again.history == got.history and np.array_equal(again.scorer.head, got.scorer.head)
    best = [i for i, h in enumerate(got.history) if h[3]]
    assert len(got.history) == 30 or len(got.history) - 1 - best[-1] == 6


def test_fit_without_training_rows(rows):
    got = fitting.fit(rows.filter("part = 'val'"), 2, [1.0, 1.0], units=3)
    assert got.history == [] and got.scorer.head.shape == (2, 6)


def test_macro_f1():
    assert fitting.macro_f1(np.array([[3, 1, 0], [1, 5, 0], [0, 0, 0]])) == pytest.approx((6 / 8 + 10 / 12) / 2)
    assert fitting.macro_f1(np.zeros((2, 2))) == 0.0
