"""Running sums, minima, maxima and last values, row numbers and quantiles over ranges of the order, so that no task sees all rows or a whole hot group.

Rows are dealt to ranges of (group, order) and written once; each range is summed, the few range totals get running sums,
and every range is finished on its own. A group of any size may span many ranges. ``order`` must be total where rows of
equal order must have stated places.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.plans.scratch import written


def joined_on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on equal keys, nulls equal to nulls; ``b`` adds its other columns. Without keys ``b`` is one row."""
    if not keys:
        return a.join(F.broadcast(b), F.lit(True), how)
    other = b.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    return a.join(other, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]), how).drop(*[f"_right_{k}" for k in keys])


def scan(df: DataFrame, values: dict[str, tuple[str, Column]], order: list[str], by: list[str] = [], backward: bool = False) -> DataFrame:  # noqa: B006  never changed
    """Adds a column per entry of ``values``: the sum, min, max or last value that isn't null over the rows of the same ``by`` up to
    and including this row in ``order``, or from this row on when ``backward`` ("last" then is the next one on).

    All entries share one pass. Any number of ranges may hold one group: what a range adds up to is carried over the
    ranges' totals, a row per group and range.
    """
    kinds = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    held = {name: f"_value{i}" for i, name in enumerate(values)}
    place = F.struct(*[F.col(o) for o in order])

    def total(kind: str, column: str) -> Column:
        if kind != "last":
            return kinds[kind](column)
        known = F.when(F.col(column).isNotNull(), place)
        return F.min_by(column, known) if backward else F.max_by(column, known)

    def combined(kind: str, earlier: str, own: Column) -> Column:
        before = F.col(earlier)
        return {"sum": lambda: F.coalesce(before, F.lit(0)) + own, "min": lambda: F.least(before, own), "max": lambda: F.greatest(before, own), "last": lambda: F.coalesce(own, before)}[kind]()

    dealt = written(df.withColumns({held[n]: v for n, (_, v) in values.items()}).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    towards = [F.desc(o) if backward else F.asc(o) for o in ["_range", *order]]
    earlier = W.partitionBy(*by).orderBy(towards[0]).rowsBetween(W.unboundedPreceding, -1)  # a row per group and range
    totals = dealt.groupBy(*by, "_range").agg(*[total(kind, held[n]).alias(f"_total{n}") for n, (kind, _) in values.items()])
    before = totals.select(*by, "_range", *[kinds[kind](f"_total{n}").over(earlier).alias(f"_before{n}") for n, (kind, _) in values.items()])
    inside = W.partitionBy(*by, "_range").orderBy(*towards[1:]).rowsBetween(W.unboundedPreceding, 0)
    out = joined_on(dealt, before, [*by, "_range"])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[combined(kind, f"_before{n}", kinds[kind](held[n]).over(inside)).alias(n) for n, (kind, _) in values.items()])


def running(df: DataFrame, value: Column, order: list[str], by: list[str] = [], name: str = "upto") -> DataFrame:  # noqa: B006
    """Adds ``name``: the sum of ``value`` over the rows of the same ``by`` up to and including this row."""
    return scan(df, {name: ("sum", value)}, order, by)


def numbered(df: DataFrame, order: list[str], by: list[str] = [], name: str = "eid") -> DataFrame:  # noqa: B006
    """Adds ``name``: 0 to n - 1 within ``by`` in order."""
    return running(df, F.lit(1).cast("long"), order, by, name).withColumn(name, F.col(name) - 1)


def counts_upto(points: DataFrame, asks: DataFrame, by: list[str], at: str, name: str = "n") -> DataFrame:
    """``asks`` with ``name``: how many of ``points`` have the same ``by`` and an ``at`` not above the ask's; both name columns of both."""
    keys = [*by, at]
    marks = points.groupBy(*keys).agg(F.count("*").alias("_count")).withColumn("_kind", F.lit(0))
    wanted = asks.select(*keys).distinct().withColumns({"_count": F.lit(0).cast("long"), "_kind": F.lit(1)})
    upto = running(marks.unionByName(wanted), F.col("_count"), [at, "_kind"], by, name).filter("_kind = 1")
    return joined_on(asks, upto.select(*keys, name), keys)


def ranked_values(df: DataFrame, value: str, by: list[str] = [], weight: str | None = None) -> DataFrame:  # noqa: B006
    """by, value, n (rows of this value), upto (rows up to and including it), total: a row per distinct value that isn't null.

    ``weight`` is a column that says how many rows each row stands for.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return joined_on(running(counts, F.col("n"), [value], by), totals, by)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """by and a column for each name in ``shares``: exact quantiles, interpolated between neighbours."""
    ranked = ranked_values(df, value, by)

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col(value)))

    out = []
    for name, q in shares.items():
        place = (F.col("total") - 1) * F.lit(q)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*by).agg(*out)


def selected_quantiles(df: DataFrame, value: str, shares: dict[str, float], cuts: int = 4096) -> DataFrame:
    """One row with a column for each name in ``shares``: as ``quantiles``, but for values that are cheaper to read thrice than to shuffle.

    Values are counted by ``cuts`` steps of equal width; distinct values are counted only of the steps that hold an asked place.
    """
    known = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    ends = known.agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("n")).first()  # one row
    if not ends["n"]:
        return df.sparkSession.createDataFrame([(None,) * len(shares)], ", ".join(f"`{name}` double" for name in shares))
    low, width = ends["low"], (ends["high"] - ends["low"]) / cuts
    step = F.least(F.lit(cuts - 1), F.floor((F.col("_v") - low) / width).cast("int")) if 0 < width < float("inf") else F.lit(0)
    held = sorted((r["s"], r["n"]) for r in known.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect())  # a row a step
    places = {name: (ends["n"] - 1) * q for name, q in shares.items()}
    asked = {int(f(x)) for x in places.values() for f in (floor, ceil)}
    before, starts = 0, []
    for s, n in held:
        if any(before <= k < before + n for k in asked):
            starts.append((s, before))
        before += n
    counts = known.withColumn("_s", step).filter(F.col("_s").isin([s for s, _ in starts])).groupBy("_s", "_v").agg(F.count("*").alias("n"))
    offset = F.create_map(*[F.lit(x) for s, b in starts for x in (s, b)])
    upto = running(counts, F.col("n"), ["_v"], ["_s"]).withColumn("_upto", F.col("upto") + offset[F.col("_s")])
    at = lambda k: F.min(F.when(F.col("_upto") > int(k), F.col("_v")))
    return upto.agg(*[(at(floor(x)) + (at(ceil(x)) - at(floor(x))) * (x - floor(x))).alias(name) for name, x in places.items()])


def islands(df: DataFrame, number: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, first, last, n: the longest runs of consecutive whole numbers among the values of ``number``, each counted once; nulls are left out."""
    distinct = df.filter(F.col(number).isNotNull()).select(*by, F.col(number).cast("long").alias("_v")).distinct()
    placed = numbered(distinct, ["_v"], by, "_k")
    return placed.groupBy(*by, (F.col("_v") - F.col("_k")).alias("_run")).agg(F.min("_v").alias("first"), F.max("_v").alias("last"), F.count("*").alias("n")).drop("_run")


def gaps(df: DataFrame, number: str, low: int, high: int) -> DataFrame:
    """first, last, n: the longest runs of whole numbers from ``low`` to ``high`` that aren't among the values of ``number``. [G6]

    Runs are numbered over ranges and each meets the next by its number, so runs of any count stay distributed.
    """
    inside = df.filter(F.col(number).between(low, high))
    ends = df.sparkSession.createDataFrame([(low - 1, low - 1), (high + 1, high + 1)], "first long, last long")
    runs = written(numbered(islands(inside, number).select("first", "last").union(ends), ["first"], name="k"), "islands")
    after = runs.select((F.col("k") - 1).alias("k"), F.col("first").alias("next"))
    out = runs.join(after, "k").select((F.col("last") + 1).alias("first"), (F.col("next") - 1).alias("last"))
    return out.filter("first <= last").withColumn("n", F.col("last") - F.col("first") + 1)
