"""Rank statistics, multiple testing, set overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.ranges import joined_on, numbered, ranked_values, running, scan
from flowloom.plans.scratch import written


def average_rank(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """Ranks from 1 within ``by``, ties sharing their mean; null for a null value. [E7]

    Ranked are the distinct values, over ranges; rows look their value's rank up.
    """
    ranks = ranked_values(df, value, by).select(*by, value, (F.col("upto") - (F.col("n") - 1) / 2).alias(name))
    return joined_on(df, ranks, [*by, value], "left")


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, rho; null with fewer than three pairs or a constant side. [H21, H23, E7]"""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, x, by, "_rx"), y, by, "_ry")
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop("_rx", "_ry").alias("_c"), F.stddev_pop("_rx").alias("_sx"), F.stddev_pop("_ry").alias("_sy"))
    return out.select(*by, "n", F.when((F.col("n") >= 3) & (F.col("_sx") > 0) & (F.col("_sy") > 0), F.col("_c") / (F.col("_sx") * F.col("_sy"))).alias("rho"))


def kendall(df: DataFrame, x: str, y: str, by: list[str], key: str, bits: int = 32) -> DataFrame:
    """by, tau (b): null with a constant side. [H21]

    No pairs are made. Values become dense ranks; two items whose y ranks differ part at one bit, above which they agree: so
    for each bit the items of one prefix count, in order of x, those of the other bit before them. ``bits`` must hold
    the number of distinct values of y.
    """
    rows = df.select(*by, F.col(key).alias("_k"), F.col(x).alias("_x"), F.col(y).alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    places = numbered(rows.select(*by, "_y").distinct(), ["_y"], by, "_place")
    placed = written(joined_on(rows, places, [*by, "_y"]), "placed")
    top = placed.agg(F.max("_place").alias("m")).first()["m"] or 0  # one number
    levels = F.array(*[F.struct(F.lit(b).alias("level"), F.expr(f"_place >> {b + 1}").alias("prefix"), F.expr(f"(_place >> {b}) & 1").alias("bit")) for b in range(min(bits, max(1, int(top).bit_length())))])
    each = placed.select(*by, "_x", F.explode(levels).alias("l")).groupBy(*by, "l.level", "l.prefix", "_x").agg(F.sum(F.when(F.col("l.bit") == 0, 1).otherwise(0)).alias("low"), F.sum(F.when(F.col("l.bit") == 1, 1).otherwise(0)).alias("high"))
    group = [*by, "level", "prefix"]
    counted = joined_on(running(each, F.col("low"), ["_x"], group), each.groupBy(*group).agg(F.sum("low").alias("all_low")), group)
    # a high item agrees with the low ones of smaller x, and disagrees with those of larger x
    pairs = counted.groupBy(*by).agg(F.sum(F.col("high") * ((F.col("upto") - F.col("low")) - (F.col("all_low") - F.col("upto")))).alias("s"))
    half = lambda c: c * (c - 1) / 2
    sizes = rows.groupBy(*by).agg(half(F.count("*")).alias("n0"))
    tied = lambda c, name: rows.groupBy(*by, c).agg(F.count("*").alias("c")).groupBy(*by).agg(F.sum(half(F.col("c"))).alias(name))
    out = joined_on(joined_on(joined_on(pairs, sizes, by), tied("_x", "tx"), by), tied("_y", "ty"), by)
    a, b = F.col("n0") - F.col("tx"), F.col("n0") - F.col("ty")
    return out.select(*by, F.when((a > 0) & (b > 0), F.col("s") / F.sqrt(a * b)).alias("tau"))


def set_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; null if both are empty. [G5]"""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n)


def top_k(scores: Column, k: int) -> Column:
    """Indices from 0 of the k largest finite scores, ties to the smaller index. [F4]"""
    marked = F.filter(F.transform(scores, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))), lambda s: s["v"].isNotNull() & ~F.isnan(s["v"]) & (F.abs(s["v"]) != float("inf")))
    return F.transform(F.slice(F.array_sort(marked), 1, k), lambda s: s["i"])


def false_discovery(df: DataFrame, p: str, family: list[str], key: str) -> DataFrame:
    """Adds q: Benjamini-Hochberg within ``family``; null p-values stay null and don't count. [E13]

    Ranks are a scan forward, the least adjusted value of this and all larger ranks a scan backward: a family of any size spans ranges.
    """
    known = df.filter(F.col(p).isNotNull())
    sizes = known.groupBy(*family).agg(F.count("*").alias("_n"))
    ranked = joined_on(scan(known, {"_r": ("sum", F.lit(1).cast("long"))}, [p, key], family), sizes, family)
    least = scan(ranked, {"q": ("min", F.col(p) * F.col("_n") / F.col("_r"))}, [p, key], family, backward=True)
    adjusted = least.select(*df.columns, F.least(F.lit(1.0), F.col("q")).alias("q"))
    return adjusted.unionByName(df.filter(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def normal_tail(z: Column) -> Column:
    """Two-sided normal tail, by a rational approximation of erfc (error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def wilcoxon(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, w, p: the paired signed-rank test (zeros dropped, normal approximation with tie correction). [H22]"""
    d = df.withColumn("_d", F.col(x) - F.col(y)).filter("_d <> 0").withColumn("_a", F.abs("_d"))
    ranked = average_rank(d, "_a", by, "_r")
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("up"), F.sum("_r").alias("all"), F.sum(F.col("_r") * F.col("_r")).alias("sq"))
    z = (F.col("up") - F.col("all") / 2) / F.sqrt(F.col("sq") / 4)
    return out.select(*by, "n", F.least(F.col("up"), F.col("all") - F.col("up")).alias("w"), normal_tail(z).alias("p"))


def friedman(df: DataFrame, value: str, block: str, treatment: str) -> DataFrame:
    """One row: blocks, treatments, statistic, from ranks of the treatments within each block. [H22]"""
    ranked = average_rank(df, value, [block], "_r")
    per = ranked.groupBy(treatment).agg(F.sum("_r").alias("s"), F.count("*").alias("n"))
    ties = ranked.agg(F.sum(F.col("_r") * F.col("_r")).alias("_sq"))
    out = per.agg(F.count("*").alias("treatments"), F.max("n").alias("blocks"), F.sum(F.col("s") * F.col("s")).alias("ss")).join(F.broadcast(ties), F.lit(True))
    k, n = F.col("treatments"), F.col("blocks")
    spread = F.col("_sq") - n * k * (k + 1) * (k + 1) / 4
    return out.select("blocks", "treatments", ((k - 1) * (F.col("ss") / n - n * k * (k + 1) * (k + 1) / 4) / spread).alias("statistic"))
