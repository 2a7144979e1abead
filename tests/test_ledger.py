"""The trial ledger: stop and resume, refusals, faults, selection with named cheap ends."""

import pytest
from pyspark.sql import functions as F

from flowloom.operators import ledger, tuning
from flowloom.plans.scratch import new_path

AXES = {"width": [8, 16, 32], "rate": [0.1, 0.2]}
CONFIG = {"seed": 7, "epochs": 3}


def score(trials):
    """Best in the middle; ties between the rates of a width."""
    return trials.select("trial", (F.lit(0.5) + F.when(F.col("width") == 16, 0.1).when(F.col("width") == 32, 0.0999).otherwise(0.0)).alias("score"))


def test_stop_and_resume(spark):
    path, seen = new_path(spark, "ledger"), []

    def watched(trials):
        seen.extend((r["trial"], r["seed"]) for r in trials.collect())
        return score(trials)

    mine = ledger.run(spark, path, AXES, CONFIG, watched, batch=2, batches=2)
    assert sorted(t for t, _ in seen) == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="missing 4 to 5"):
        ledger.promote(spark, path, AXES, CONFIG, 0.0)
    assert ledger.run(spark, path, AXES, CONFIG, watched, batch=4) == mine
    assert sorted(seen) == [(t, t + 7) for t in range(6)]  # none twice
    ledger.run(spark, path, AXES, CONFIG, watched, batch=4)
    assert len(seen) == 6
    whole = new_path(spark, "ledger")
    ledger.run(spark, whole, AXES, CONFIG, score, batch=100)
    a, b = (sorted(map(tuple, ledger.promote(spark, p, AXES, CONFIG, 0.05).collect())) for p in (path, whole))
    assert a == b
    assert [(r[0], *r[4:]) for r in a if r[5]] == [(2, True, True, True), (3, False, True, False), (4, False, True, False), (5, False, True, False)]


def test_another_grid_or_configuration_is_refused(spark):
    path = new_path(spark, "ledger")
    ledger.run(spark, path, AXES, CONFIG, score, batch=3, batches=1)
    for axes, config in (({**AXES, "width": [8, 16]}, CONFIG), (AXES, {**CONFIG, "epochs": 4})):
        with pytest.raises(ValueError, match="another grid"):
            ledger.run(spark, path, axes, config, score, batch=3)
    ledger.append(spark.createDataFrame([(5, 0.9)], "trial long, score double"), path, "other")
    with pytest.raises(ValueError, match="trial 5 was made"):
        ledger.run(spark, path, AXES, CONFIG, score, batch=3)


def test_every_fault_is_named(spark):
    path = new_path(spark, "ledger")
    mine = ledger.open_ledger(spark, path, AXES, CONFIG)
    rows = [(0, 0.1), (0, 0.1), (3, 0.2), (3, 0.3), (9, 0.5)]
    ledger.append(spark.createDataFrame(rows, "trial long, score double"), path, mine)
    with pytest.raises(ValueError, match="missing 1 to 2; several results 3; missing 4 to 5; foreign 9"):
        ledger.promote(spark, path, AXES, CONFIG, 0.0)


def test_a_batch_without_a_score_is_an_error(spark):
    with pytest.raises(ValueError, match="no score"):
        ledger.run(spark, new_path(spark, "ledger"), AXES, CONFIG, lambda t: score(t).filter("trial <> 1"), batch=3)


def test_cheap_ends_and_foreign_values(spark):
    scored = tuning.grid(spark, AXES).withColumn("score", F.lit(0.5))
    best = lambda **k: tuning.select_best_in_band(scored, 0.0, AXES, **k).first()
    assert best()["trial"] == 0
    assert best(cheapest={"rate": "last", "width": "first"})["trial"] == 1
    assert best(cheapest={"width": "last"})["trial"] == 4
    assert best(cheapest={})["trial"] == 0
    for bad in ({"depth": "first"}, {"width": "middle"}):
        with pytest.raises(ValueError, match="cheap end"):
            best(cheapest=bad)
    odd = scored.withColumn("width", F.when(F.col("trial") == 5, 64).otherwise(F.col("width")))
    with pytest.raises(ValueError, match="trial 5"):
        tuning.select_best_in_band(odd, 0.0, AXES, cheapest={"width": "first"})
    assert tuning.select_best_in_band(odd, 0.0, AXES, cheapest={"rate": "first"}).first()["trial"] == 0
    with pytest.raises(ValueError, match="band"):
        tuning.select_best_in_band(scored, -1.0, AXES)
