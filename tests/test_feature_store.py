"""The feature store: readback, refused keys, files that a lookup reads, absent keys."""

import pytest
from pyspark.sql import functions as F

from flowloom.plans.scratch import new_path
from flowloom.sources import feature_store as store


@pytest.fixture(scope="module")
def kept(spark):
    """Even keys below 40,000 in 8 files."""
    path = new_path(spark, "store")
    df = spark.range(20_000).select((F.col("id") * 2).alias("eid"), (F.col("id") * 0.5).alias("v")).repartition(5)
    return path, store.write_store(df, path, files=8)


def test_files_are_consecutive_ranges(spark, kept):
    path, manifest = kept
    files = sorted(manifest.collect(), key=lambda r: r["lo"])
    assert len(files) == 8 and sum(f["n"] for f in files) == 20_000
    assert files[0]["lo"] == 0 and files[-1]["hi"] == 39_998
    assert all(a["hi"] < b["lo"] for a, b in zip(files, files[1:]))
    assert store.read_store(spark, path).count() == 20_000


def test_lookup_keeps_repeats_and_columns(spark, kept):
    asks = spark.createDataFrame([(4, "a"), (4, "b"), (39_998, "c"), (0, None)], "eid long, note string")
    got = sorted(map(tuple, store.features(spark, kept[0], asks).select("eid", "note", "v").collect()), key=repr)
    assert got == [(0, None, 0.0), (39_998, "c", 9_999.5), (4, "a", 1.0), (4, "b", 1.0)]


def test_only_files_that_may_hold_a_key_are_read(spark, kept):
    path, manifest = kept
    files = sorted(manifest.collect(), key=lambda r: r["lo"])
    asks = spark.createDataFrame([(files[2]["lo"],), (files[2]["hi"],), (files[5]["lo"] + 2,)], "eid long")
    rows = store.candidates(spark, path, store.located(spark, path, asks))
    assert sorted(f.rsplit("/", 1)[1] for f in rows.inputFiles()) == sorted([files[2]["file"], files[5]["file"]])
    assert rows.count() == files[2]["n"] + files[5]["n"]


def test_bloom_filters_lose_no_key_and_stop_most_absent_ones(spark, kept):
    path, _ = kept
    there = store.located(spark, path, spark.range(20_000).select(F.col("id") * 2))
    assert there.count() == 20_000 and there.filter("file IS NULL").count() == 0
    odd = store.located(spark, path, spark.range(19_999).select(F.col("id") * 2 + 1))
    assert odd.filter("file IS NOT NULL").count() < 0.05 * 19_999


def test_absent_keys(spark, kept):
    asks = spark.createDataFrame([(4,), (5,), (5,), (None,), (-1,), (40_000,)], "k long")
    assert sorted((r["k"] for r in store.absent(spark, kept[0], asks).collect()), key=repr) == [-1, 40_000, 5, None]
    with pytest.raises(KeyError):
        store.features(spark, kept[0], spark.createDataFrame([(4,), (7,)], "eid long"))
    with pytest.raises(KeyError):
        store.features(spark, kept[0], spark.createDataFrame([(None,)], "eid long"))
    with pytest.raises(ValueError, match="both sides"):
        store.features(spark, kept[0], spark.createDataFrame([(4, 1.0)], "eid long, v double"))


@pytest.mark.parametrize("keys", [[1, 2, 2, 3], [1, None, 2]])
def test_repeated_and_null_keys_are_refused(spark, keys):
    path = new_path(spark, "store")
    with pytest.raises(ValueError, match="null, repeated"):
        store.write_store(spark.createDataFrame([(k,) for k in keys], "eid long"), path, files=2)
    with pytest.raises(Exception):
        store.open_store(spark, path)


def test_unsorted_and_overlapping_files_are_refused(spark):
    for rows, parts in (([3, 1, 2], 1), ([1, 3, 2, 4], 2)):
        path = new_path(spark, "store")
        spark.sparkContext.parallelize([(k,) for k in rows], parts).toDF("eid long").write.parquet(f"{path}/data")
        with pytest.raises(ValueError):
            store.seal(spark, path)


def test_changed_data_are_refused(spark):
    path = new_path(spark, "store")
    store.write_store(spark.range(10).withColumnRenamed("id", "eid"), path)
    spark.range(10, 12).withColumnRenamed("id", "eid").write.mode("append").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="manifest"):
        store.read_store(spark, path)


def test_empty_store_and_text_keys(spark):
    path = new_path(spark, "store")
    store.write_store(spark.range(0).withColumnRenamed("id", "eid"), path)
    assert store.read_store(spark, path).count() == 0
    asks = spark.createDataFrame([(1,)], "eid long")
    assert [r["eid"] for r in store.absent(spark, path, asks).collect()] == [1]
    path = new_path(spark, "store")
    store.write_store(spark.createDataFrame([("b", 1), ("", 2), ("é", 3)], "name string, v int"), path, "name", 2)
    got = store.features(spark, path, spark.createDataFrame([("é",), ("",)], "name string"), "name")
    assert sorted(map(tuple, got.collect())) == [("", 2), ("é", 3)]
