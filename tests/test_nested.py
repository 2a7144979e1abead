"""JSON of unknown shape, per-class measurements, three topologies compared; games that fail."""

import pytest
from pyspark.sql import functions as F

from flowloom.operators import failures, flow_games, nested, shapley
from tests.test_flow_games import WINDOW, _scorer, flows  # noqa: F401  flows is a fixture


def test_paths_of_any_shape(spark):
    texts = ['{"a": {"b": [1, 2.5, "x", null, true], "c.d": {}}, "": 1}', "bad", None, "[]", "3", '{"a": 1, "a": 2}', '"s"', "null", "", '[[["deep"]]]', "3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, value string")  # a column named like one inside
    got = {}
    for row in nested.json_paths(docs, "value", ["id"]).collect():
        got.setdefault(row["id"], []).append((row["path"], row["kind"], row["number"], row["text"]))
    assert sorted(got[0]) == sorted([
        ("$", "object", None, None), ("$.a", "object", None, None), ("$.a.b", "array", None, None), ("$.a.b[0]", "number", 1.0, "1"), ("$.a.b[1]", "number", 2.5, "2.5"), ("$.a.b[2]", "string", None, "x"),
        ("$.a.b[3]", "null", None, None), ("$.a.b[4]", "boolean", None, "true"), ("$.a.c.d", "object", None, None), ("$.", "number", 1.0, "1")])
    assert got[1] == got[5] == got[8] == [("$", "malformed", None, None)] and 2 not in got
    assert got[3] == [("$", "array", None, None)] and got[4] == got[10] == [("$", "number", 3.0, "3")] and got[7] == [("$", "null", None, None)] and got[6] == [("$", "string", None, "s")]
    assert sorted(p for p, *_ in got[9]) == ["$", "$[0]", "$[0][0]", "$[0][0][0]"]
    assert nested.json_paths(docs.limit(0), "value", ["id"]).count() == 0
    with pytest.raises(ValueError, match="kind"):
        nested.json_paths(docs.withColumnRenamed("id", "kind"), "value", ["kind"])


def test_values_are_read_once(spark):
    made = nested.json_paths(spark.createDataFrame([(1, '{"a": [1, "x"]}')], "id int, j string"), "j", ["id"])
    assert "variant" not in made._jdf.queryExecution().executedPlan().toString()  # kinds, numbers and texts are stored with their level
    assert sorted(r["path"] for r in made.collect()) == ["$", "$.a", "$.a[0]", "$.a[1]"]


def test_measurements_by_class(spark):
    text = '{"d": {"per_class": {"dos": {"mean": 1.5, "n": "7", "more": [1]}, "a.b": {"mean": null, "n": 2}, "none": {}}}, "x": {"per_class": {"other": {"mean": 9}}}}'
    paths = nested.json_paths(spark.createDataFrame([(1, text), (2, '{"d": 1}')], "run int, j string"), "j", ["run"])
    got = {(r["run"], r["cls"]): (r["m"], r["k"]) for r in nested.per_class(paths, ["d", "per_class"], {"mean": "m", "n": "k"}, ["run"]).collect()}
    assert got == {(1, "dos"): (1.5, 7.0), (1, "a.b"): (None, 2.0), (1, "none"): (None, None)}


def test_topologies_compared(spark):
    edges = spark.createDataFrame([("fan", 0, d) for d in range(6)] + [("same", 1, 2)] * 4 + [("ours", 3, 4)], "cls string, src long, dst long")
    stage = spark.createDataFrame([("fan", 1.0, 6.0, 2.5), ("same", 1.0, 1.0, None), ("theirs", 0.0, 3.0, None)], "cls string, n_src double, n_dst double, d double")
    want = spark.createDataFrame([("fan", "fan_out"), ("same", "fan_in"), ("nobody", "other")], "cls string, literature string")
    got = {r["cls"]: tuple(r)[1:] for r in nested.structural_coherence(edges, stage, want).collect()}
    assert got == {
        "fan": ("fan_out", "fan_out", "fan_out", "full", 6, 1.0, 6.0, 2.5), "same": ("persistent", "fan_in", "persistent", "ours_measured", 4, 1.0, 1.0, None),
        "ours": ("persistent", "not_supplied", "indeterminate", "literature_missing", 1, None, None, None), "theirs": ("indeterminate", "not_supplied", "indeterminate", "literature_missing", 0, 0.0, 3.0, None)}
    assert {r["literature"] for r in nested.structural_coherence(edges, stage).collect()} == {"not_supplied"}
    with pytest.raises(ValueError, match="literature"):
        nested.structural_coherence(edges, stage, want.drop("literature"))


def test_a_poisoned_flow_is_a_row(spark, flows):  # noqa: F811
    _, _, context, records = flows
    bad = F.transform("nodes", lambda n, i: n.withField("x", F.when(i == 0, F.transform(n["x"], lambda v, k: F.when(k == 1, float("nan")).otherwise(v))).otherwise(n["x"])))
    poisoned = context.withColumn("nodes", F.when(F.col("seed_eid") == 40, bad).otherwise(F.col("nodes"))).withColumn("label", F.when(F.col("seed_eid") == 17, 7).otherwise(F.col("label")))
    clean = {r["seed_eid"]: r for r in flow_games.neighbour_games(context, records, _scorer(), WINDOW).collect()}
    played, seen = failures.watched(flow_games.neighbour_games(poisoned, records, _scorer(), WINDOW, errors=True))
    got = {r["seed_eid"]: r for r in played.collect()}
    assert "isn't finite" in got[40]["error"] and got[17]["error"].startswith("IndexError") and got[40]["players"] is None and got[17]["base"] is None
    for eid in (0, 59):  # without neighbours
        assert got[eid]["error"] is None and tuple(got[eid])[:-1] == tuple(clean[eid])
    alone = {r["seed_eid"]: r for r in flow_games.neighbour_games(poisoned.filter("seed_eid <> 17").unionByName(context.filter("seed_eid = 17")), records, _scorer(), WINDOW, errors=True).collect()}
    assert tuple(alone[17])[:-1] == tuple(clean[17]) and alone[17]["players"] and alone[40]["error"]
    assert seen.get == {"n": 4, "failed": 2}
    assert {(r["error"] is None, r["n"]) for r in failures.outcomes(played.withColumn("error", F.substring("error", 1, 3)), []).collect()} == {(True, 2), (False, 1)}
    usual = flow_games.label_backgrounds(context)
    nodes = {r["seed_eid"]: r["error"] for r in flow_games.node_games(poisoned.filter("seed_eid <> 17"), usual, _scorer(), errors=True).collect()}
    assert "isn't finite" in nodes[40] and nodes[0] is None and nodes[59] is None
    with pytest.raises(Exception, match="isn't finite"):
        flow_games.neighbour_games(poisoned.filter("seed_eid = 40"), records, _scorer(), WINDOW).collect()


def test_faulty_features_are_rows(spark):
    rows = [(1, [1.0, 2.0], [0.0, 0.0]), (2, None, [0.0, 0.0]), (3, [1.0], [0.0, 0.0]), (4, [1.0, float("nan")], [0.0, 0.0]), (5, [1.0, 2.0], [None, float("inf")]), (6, [], [0.0, 0.0]), (7, [1.0, 2.0], None), (1, [1.0, 2.0], [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "eid long, x array<double>, background array<double>")
    got = [(r["eid"], r["error"], r["phi"] is None, r["degenerate"]) for r in shapley.feature_attribution(frame, [[0], [1]], [0.5, -0.5], 0.1, errors=True).collect()]
    assert sorted(got, key=str) == sorted([
        (1, None, False, 0), (1, None, False, 0), (2, "x missing", True, None), (3, "x has 1 values, not 2", True, None), (4, "x {1} not finite", True, None), (5, "background {0,1} not finite", True, None),
        (6, "x has 0 values, not 2", True, None), (7, "background missing", True, None)], key=str)
    assert shapley.feature_attribution(frame.limit(0), [[0], [1]], [0.5, -0.5], 0.1, errors=True).count() == 0
    plain = shapley.feature_attribution(frame.filter("eid = 1"), [[0], [1]], [0.5, -0.5], 0.1)
    assert plain.columns == ["eid", "phi", "base", "value", "degenerate"] and plain.count() == 2
