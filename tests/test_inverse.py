"""Inverses of the fitted encoders."""

import pytest

from flowloom.functions import encode


def test_scaler_and_categories_come_back(spark):
    rows = [(1, 4.0, 7.0, "a", "x"), (2, None, 7.0, "a", None), (3, -2.5, 7.0, None, ""), (4, 1e6, 7.0, "rare", "y")] + [(i, float(i), 7.0, "a", "z") for i in range(5, 30)]
    df = spark.createDataFrame(rows, "eid long, v double, same double, k string, v_decoded string")
    train = df.filter("eid <> 4")
    found, names = encode.fit_scaler(train, ["v", "same"]), encode.fit_categories(train.union(df.filter("eid = 3")), "k", 0.05)
    coded = encode.encode_categories(encode.scale_with(df, found, ["v", "same"]), names, "k")
    got = {r["eid"]: r for r in encode.decode_categories(encode.unscale_with(coded, found, ["v", "same"]), names, "k").collect()}
    assert len(got) == len(rows)
    for eid, v, same, k, extra in rows:
        r = got[eid]
        assert r["v"] == (None if v is None else pytest.approx(v)) and r["same"] == same and r["v_decoded"] == extra
        assert r["k_decoded"] == (None if k == "rare" else k or "nan")


def test_rare_and_unknown_indexes_are_null(spark):
    names = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "value string, index int")
    coded = spark.createDataFrame([(0,), (1,), (9,), (None,)], "k_index int")
    assert {r["k_index"]: r["k_decoded"] for r in encode.decode_categories(coded, names, "k").collect()} == {0: None, 1: "a", 9: None, None: None}


def test_columns_that_were_not_fitted_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "v double, w double")
    found = encode.fit_scaler(df, ["v"])
    for columns in (["w"], ["v", "absent"]):
        with pytest.raises(ValueError, match="not scaled"):
            encode.unscale_with(df, found, columns)
    assert encode.unscale_with(df.limit(0), found, ["v"]).collect() == []
