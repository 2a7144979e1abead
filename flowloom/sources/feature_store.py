"""Range-partitioned feature store: Parquet sorted by a key without repeats, with a manifest of key ranges and Bloom filters.

``data`` holds files of consecutive, disjoint key ranges; ``manifest`` a row per file; ``bloom`` the files' filters in
blocks of 4 KiB, each a bitmap of the keys that hash to it. The manifest is written last, so a store whose writing
stopped midway can't be opened. A lookup finds each key's file by the ranges and its block by the hash, and
reads only the files that some asked key may be in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.operators.ranges import scan
from flowloom.plans.scratch import written

#: Bits of a bitmap that Spark's bitmap functions build.
BITS = 32_768
#: Bits a key, and how many of them it sets: about 1 % of absent keys pass.
BITS_PER_KEY = 10
HASHES = 4


def write_store(df: DataFrame, path: str, key: str = "eid", files: int | None = None) -> DataFrame:
    """Writes ``df`` as a store and returns its manifest; ``files`` ranges, or as many as adaptive execution makes. [A3]

    A null or repeated key is a ValueError, and the store stays without a manifest. An empty table makes an empty store.
    """
    dealt = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.parquet(f"{path}/data")
    return seal(df.sparkSession, path, key)


def seal(spark: SparkSession, path: str, key: str = "eid") -> DataFrame:
    """Checks the data as it is stored, then writes its filters and its manifest (file, lo, hi, n, blocks). [A3, A4]

    ValueError unless keys rise strictly within every file, none is null, and the files' ranges don't overlap.
    """
    stored = spark.read.parquet(f"{path}/data").select(F.col(key).alias("key"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    before = F.lag("key").over(W.partitionBy("file").orderBy("place"))  # one file's keys; a file is one task's output
    checked = stored.withColumn("_wrong", F.col("key").isNull() | F.coalesce(F.col("key") <= before, F.lit(False)))
    files = written(checked.groupBy("file").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"), F.count_if("_wrong").alias("wrong")), "files")
    overlap = F.coalesce(F.col("lo") <= F.lag("hi").over(W.orderBy("lo", "hi")), F.lit(False))  # a row per file
    bad = files.withColumn("overlap", overlap).filter("wrong > 0 OR overlap").head(1)
    if bad:
        raise ValueError(f"keys of {bad[0]['file']} are null, repeated, unsorted or overlap with another file's")
    manifest = files.select("file", "lo", "hi", "n", F.ceil(F.col("n") * BITS_PER_KEY / BITS).alias("blocks"))
    keyed = stored.join(F.broadcast(manifest.select("file", "blocks")), "file")  # a name and a number per file
    marked = keyed.select("file", _block("key", "blocks").alias("block"), F.explode(_positions("key")).alias("position"))
    marked.groupBy("file", "block").agg(F.bitmap_construct_agg("position").alias("bits")).write.parquet(f"{path}/bloom")
    manifest.write.parquet(f"{path}/manifest")
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; raises if the store isn't complete. [A4]"""
    return spark.read.parquet(f"{path}/manifest")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All rows; ValueError if the data don't have the manifest's count. [A4]"""
    rows = spark.read.parquet(f"{path}/data")
    said = open_store(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if rows.count() != said:  # from footers
        raise ValueError(f"{path} doesn't hold the {said} rows of its manifest")
    return rows


def _block(key: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(blocks))


def _positions(key: str) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(BITS)) for i in range(1, HASHES + 1)])


def located(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """key, file: the distinct values of ``keys``' only column, each with the file that may hold it, or null if none does.

    Ranges are met by a running last over (key, kind), so neither a range join nor a broadcast of the manifest is needed.
    """
    asked = keys.select(F.col(f"`{keys.columns[0]}`").alias("key")).distinct()
    manifest = open_store(spark, path)
    type_of = manifest.schema["lo"].dataType
    heads = manifest.select(F.col("lo").alias("key"), F.lit(0).alias("kind"), F.struct("file", "hi", "blocks").alias("head"))
    asks = asked.select(F.col("key").cast(type_of).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(heads.schema["head"].dataType).alias("head"))
    nearest = scan(heads.unionByName(asks), {"at": ("last", F.col("head"))}, ["key", "kind"]).filter("kind = 1")
    inside = F.col("key") <= F.col("at.hi")
    ranged = nearest.select("key", F.when(inside, F.col("at.file")).alias("in_file"), F.when(inside, F.pmod(F.xxhash64("key"), F.col("at.blocks"))).alias("in_block"), _positions("key").alias("positions"))
    bloom = spark.read.parquet(f"{path}/bloom").select(F.col("file").alias("in_file"), F.col("block").alias("in_block"), "bits")
    met = ranged.join(bloom, ["in_file", "in_block"], "left")

    def is_set(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return F.getbit(byte, (p % 8).cast("int")) == 1

    return met.select("key", F.when(F.col("bits").isNotNull() & F.forall("positions", is_set), F.col("in_file")).alias("file"))


def candidates(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The rows of the files that ``places`` (of ``located``) names, and of no other. The names of files reach the driver, as in any scan."""
    names = [row["file"] for row in places.select("file").filter("file IS NOT NULL").distinct().collect()]
    rows = spark.read.parquet(f"{path}/data")
    return spark.read.schema(rows.schema).parquet(*[f"{path}/data/{n}" for n in names]) if names else rows.limit(0)


def absent(spark: SparkSession, path: str, keys: DataFrame, key: str = "eid") -> DataFrame:
    """The distinct values of ``keys``' only column that the store doesn't hold, null among them, under that column's name."""
    places = written(located(spark, path, keys), "places")
    there = candidates(spark, path, places).select(F.col(key).alias("key"))
    return places.join(there, "key", "left_anti").select(F.col("key").alias(keys.columns[0]))


def features(spark: SparkSession, path: str, asks: DataFrame, key: str = "eid") -> DataFrame:
    """``asks`` with the stored columns of its ``key``: repeats and other columns stay. A key that isn't stored, or null, is a KeyError. [C3]

    A stored column that ``asks`` has too is a ValueError.
    """
    places = written(located(spark, path, asks.select(key)), "places")
    rows = candidates(spark, path, places)
    clash = (set(rows.columns) & set(asks.columns)) - {key}
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    missing = places.join(rows.select(F.col(key).alias("key")), "key", "left_anti").limit(1).collect()
    if missing:
        raise KeyError(missing[0]["key"])
    return asks.join(rows, key)
