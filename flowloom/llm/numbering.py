"""Row numbers, and joins with one row per key, without a task that gets all rows of a hot key.

Rows are dealt to a fixed number of hash buckets, rows of a hot hash to several of their own; the buckets' totals, of which
there is a bounded number, get running sums in a small window, and each bucket is numbered on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.plans.scratch import written

#: Buckets of each group. At 30 billion rows a bucket holds about 7 million narrow rows, which sort and spill.
BUCKETS = 4096


def bucket_of(key: Column) -> Column:
    """Bucket 0 to BUCKETS - 1 of a 64-bit hash."""
    return F.pmod(key, F.lit(BUCKETS)).cast("int")


#: A key with more than this share of all rows is hot. There are fewer than 1 / HOT_SHARE of them, at any size.
HOT_SHARE = 1e-4


def numbered(df: DataFrame, hash_col: str, order: list[str]) -> DataFrame:
    """Adds ``row_no`` (0 to n - 1, gapless) and ``row_total`` (n, on every row).

    The order is that of (bucket of ``hash_col``, ``order``), which depends on the rows alone: not on files,
    partitions or retries. Rows equal in all of ``order`` are interchangeable; equal rows should have equal hashes. Rows of
    a hot hash leave their bucket for parts of their own, as many as their share calls for; these rows alone are written.
    """
    counts = written(df.groupBy(hash_col).agg(F.count("*").alias("_n")), "hash-counts")
    total = counts.agg(F.sum("_n").alias("n")).first()["n"] or 0  # one number
    hot = counts.filter((F.col("_n") > 1) & (F.col("_n") > total * HOT_SHARE))  # fewer than 1 / HOT_SHARE hashes
    sizes = counts.join(F.broadcast(hot.select(hash_col)), hash_col, "left_anti").groupBy(bucket_of(F.col(hash_col)).alias("_b")).agg(F.sum("_n").alias("_size")).select("_b", F.lit(None).cast("long").alias("_o"), F.lit(0).cast("long").alias("_p"), "_size")
    none = {"_own": F.lit(None).cast("long"), "_part": F.lit(0).cast("long")}
    if hot.isEmpty():
        rows = df.withColumns(none)
    else:
        parts = hot.select(hash_col, F.ceil(F.col("_n") * (BUCKETS / total)).cast("long").alias("_parts"))
        salted = df.join(F.broadcast(parts), hash_col).withColumns({"_own": F.col(hash_col), "_part": F.pmod(F.monotonically_increasing_id(), "_parts")}).drop("_parts")
        salted = written(salted.select(*df.columns, "_own", "_part"), "hot-rows")
        rows = df.join(F.broadcast(hot.select(hash_col)), hash_col, "left_anti").withColumns(none).select(*df.columns, "_own", "_part").unionByName(salted)
        sizes = sizes.unionByName(salted.groupBy(bucket_of(F.col("_own")).alias("_b"), F.col("_own").alias("_o"), F.col("_part").alias("_p")).agg(F.count("*").alias("_size")))
    before = W.orderBy("_b", F.asc_nulls_first("_o"), "_p").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_b", "_o", "_p", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_bucket", "_own", "_part").orderBy(*order)
    same = (F.col("_bucket") == F.col("_b")) & F.col("_own").eqNullSafe(F.col("_o")) & (F.col("_part") == F.col("_p"))
    # starts has 2 BUCKETS + 2 / HOT_SHARE rows at most, whatever the size of df
    return (
        rows.withColumn("_bucket", bucket_of(F.col(hash_col))).join(F.broadcast(starts), same)
        .withColumns({"row_no": F.col("_start") + F.row_number().over(inside) - 1, "row_total": F.lit(total).cast("long")})
        .drop("_bucket", "_own", "_part", "_start", "_b", "_o", "_p")
    )


def looked_up(rows: DataFrame, facts: DataFrame, key: str, count: str = "_n") -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row per key; ``count``: how many rows have it), null where there is none.

    Facts of hot keys go to every task (fewer than 1 / HOT_SHARE rows), so rows of a hot key stay where they are; all
    others meet by a shuffle. ``rows`` is read twice and should be a written table; its keys must not be null.
    """
    total = facts.agg(F.sum(count).alias("n")).first()["n"] or 0  # one number
    is_hot = F.col(count) > F.lit(total * HOT_SHARE)
    hot, cold = facts.filter(is_hot).drop(count), facts.filter(~is_hot).drop(count)
    near = rows.join(F.broadcast(hot), key)
    return near.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left"))


def row_order(df: DataFrame) -> Column:
    """A hash of a whole row: the order in which rows that agree in all else are taken. Maps and variants can't be hashed and are left out."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))])
