"""How classes spread over time: histograms, quantiles, bursts, boundary density, gaps, sub-windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.operators.ranges import joined_on, numbered

HOUR = 3_600_000


def span(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: n, t0, t1, span."""
    return df.agg(F.count("*").alias("n"), F.min(ts).alias("t0"), F.max(ts).alias("t1")).withColumn("span", F.col("t1") - F.col("t0"))


def largest_gap(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: gap, gap_start, gap_end, zoom_start. [E8]

    The zoom starts where the largest gap ends if the gap is at least 5 % of the span, else at 90 % of it. Times are first reduced to
    the first and last of each hour bucket, so the ordered pass is over buckets.
    """
    hours = df.groupBy(F.floor(F.col(ts) / HOUR).alias("h")).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    between = hours.withColumn("prev", F.lag("b").over(W.orderBy("h"))).select(F.col("prev").alias("s"), F.col("a").alias("e"))
    inside = df.select(F.floor(F.col(ts) / HOUR).alias("h"), F.col(ts).alias("e")).distinct()
    inside = inside.withColumn("s", F.lag("e").over(W.partitionBy("h").orderBy("e"))).select("s", "e")
    best = between.union(inside).filter("s IS NOT NULL").agg(F.max(F.struct((F.col("e") - F.col("s")).alias("gap"), (-F.col("s")).alias("neg"), "s", "e")).alias("m"))
    both = best.join(F.broadcast(span(df, ts)), F.lit(True))
    zoom = F.when(F.col("m.gap") >= 0.05 * F.col("span"), F.col("m.e").cast("double")).otherwise(F.col("t0") + 0.9 * F.col("span"))
    return both.select(F.col("m.gap").alias("gap"), F.col("m.s").alias("gap_start"), F.col("m.e").alias("gap_end"), zoom.alias("zoom_start"))


def histogram(df: DataFrame, bins_per_hour: int = 1, ts: str = "ts", cls: str = "cls") -> DataFrame:
    """cls, bin, n: counts per class and bin of elapsed time. [I2, I3, H29]"""
    t0 = df.agg(F.min(ts).alias("_t0"))
    elapsed = (F.col(ts) - F.col("_t0")) / HOUR
    return df.join(F.broadcast(t0), F.lit(True)).groupBy(F.col(cls).alias("cls"), F.floor(elapsed * bins_per_hour).alias("bin")).agg(F.count("*").alias("n"))


def fine_grid(df: DataFrame, extra: DataFrame, bin_seconds: float = 1.0, most_bins: int = 5_000_000, ts: str = "ts") -> DataFrame:
    """One row: t0, hours, per_hour, extra, bins: a grid of equal bins of elapsed hours, with the edges of ``extra`` put in. [H29]

    Every full hour is an edge. Above ``most_bins`` the hour is cut into fewer bins, at least one, so the number of bins may
    pass the bound on spans of more hours than that. ``extra`` is one row, extra_h: edges in elapsed hours, of which those
    outside the grid or within a millionth of half a bin of another edge are left out, the earlier in the list staying.
    """
    s = span(df, ts).join(F.broadcast(extra.select("extra_h")), F.lit(True))  # one row each
    wanted = round(3600 / bin_seconds)
    s = s.withColumn("hours", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("span") / HOUR)))
    s = s.withColumn("per_hour", F.when(F.col("hours") * wanted > most_bins, F.greatest(F.lit(1).cast("long"), F.floor(F.lit(most_bins) / F.col("hours")))).otherwise(F.lit(wanted).cast("long")))
    close = lambda a, b: F.abs(a - b) <= 0.5e-6 / F.col("per_hour")

    def put_in(kept: Column, x: Column) -> Column:
        new = (x > 0) & (x < F.col("hours")) & ~close(F.round(x * F.col("per_hour")) / F.col("per_hour"), x) & ~F.exists(kept, lambda k: close(k, x))
        return F.when(new, F.concat(kept, F.array(x))).otherwise(kept)

    kept = F.array_sort(F.aggregate(F.coalesce("extra_h", F.array().cast("array<double>")), F.array().cast("array<double>"), put_in))
    s = s.withColumn("extra", kept)
    return s.select("t0", "hours", "per_hour", "extra", (F.col("hours") * F.col("per_hour") + F.size("extra")).alias("bins"))


def fine_histogram(df: DataFrame, grid: DataFrame, ts: str = "ts", cls: str = "cls") -> DataFrame:
    """cls, bin, start_h, end_h, n: counts of each class in the bins of ``fine_grid``; bins without rows are absent. [I2]

    A bin holds its start and not its end, but for the last one. A row's bin is computed from its time: the equal bin by
    division, mended where rounding put it beside the edge, and how many inserted edges are not above it.
    """
    e, per, top = F.col("_e"), F.col("_g.per_hour"), F.col("_g.hours") * F.col("_g.per_hour") - 1
    both = df.select(F.col(cls).alias("cls"), F.col(ts).alias("_ts")).filter("_ts IS NOT NULL").join(F.broadcast(grid.select(F.struct("*").alias("_g"))), F.lit(True))
    both = both.withColumn("_e", (F.col("_ts") - F.col("_g.t0")) / HOUR).withColumn("_k", F.floor(e * per))
    k = F.col("_k") + F.when(e >= (F.col("_k") + 1) / per, 1).when(e < F.col("_k") / per, -1).otherwise(0)
    both = both.withColumn("_k", F.least(k, top)).withColumn("_j", F.size(F.filter("_g.extra", lambda x: x <= e)))
    start, end = F.col("_k") / per, (F.col("_k") + 1) / per
    before, after = F.get("_g.extra", F.col("_j") - 1), F.get("_g.extra", F.col("_j"))
    binned = both.select("cls", (F.col("_k") + F.col("_j")).alias("bin"), F.greatest(start, before).alias("start_h"), F.least(end, after).alias("end_h"))
    return binned.groupBy("cls", "bin", "start_h", "end_h").agg(F.count("*").alias("n"))


def split_support(df: DataFrame, taus: DataFrame, ts: str = "ts", cls: str = "cls") -> DataFrame:
    """cls, n, n_train, n_val, n_test, and tie_train and tie_val, the rows exactly at the cuts. [I2]"""
    both = df.join(F.broadcast(taus.select("tau_train", "tau_val")), F.lit(True))
    t, a, b = F.col(ts), F.col("tau_train"), F.col("tau_val")
    counts = {"n_train": t <= a, "n_val": (t > a) & (t <= b), "n_test": t > b, "tie_train": t == a, "tie_val": t == b}
    return both.groupBy(F.col(cls).alias("cls")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def cumulative(hist: DataFrame) -> DataFrame:
    """Adds cdf: the share of the class up to and including the bin. [E9]"""
    upto = W.partitionBy("cls").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return hist.withColumn("cdf", F.sum("n").over(upto) / F.sum("n").over(W.partitionBy("cls")))


def hist_quantiles(hist: DataFrame, qs: list[float]) -> DataFrame:
    """cls and the first bin whose cumulative share reaches each q: q10, q50, ... [E9]"""
    c = cumulative(hist)
    return c.groupBy("cls").agg(*[F.min(F.when(F.col("cdf") >= q, F.col("bin"))).alias(f"q{round(q * 100)}") for q in qs])


def windowed_sum(hist: DataFrame, centre: float, half: float) -> DataFrame:
    """cls, n: counts of bins whose centre is within ``half`` bins of ``centre``. [E10]"""
    return hist.groupBy("cls").agg(F.coalesce(F.sum(F.when(F.abs(F.col("bin") + 0.5 - centre) <= half, F.col("n"))), F.lit(0)).alias("n"))


def hourly_peaks(hist: DataFrame) -> DataFrame:
    """cls, peak_bin, peak, median of the non-zero bins. [I3]"""
    return hist.groupBy("cls").agg(F.max(F.struct("n", -F.col("bin"))).alias("m"), F.percentile("n", F.lit(0.5)).alias("median")).select("cls", (-F.col("m.col2")).alias("peak_bin"), F.col("m.n").alias("peak"), "median")


def bursts(hist: DataFrame, zoom_bins: float) -> DataFrame:
    """cls, q10, q50, q90, burst: half of the class in the first fifth of its inner span, early in the zoom. [I4]"""
    q = hist_quantiles(hist, [0.1, 0.5, 0.9])
    early = F.col("q50") - F.col("q10") <= 0.2 * (F.col("q90") - F.col("q50"))
    return q.withColumn("burst", early & (F.col("q50") <= 0.25 * zoom_bins))


def boundary_density(df: DataFrame, taus: DataFrame, share: float = 0.01, times: float = 5.0, ts: str = "ts", cls: str = "cls") -> DataFrame:
    """cls, n, near, density, dense: rows within ``share`` of the span around the training cut, against an even spread. [I5]"""
    s = span(df, ts).join(F.broadcast(taus.select("tau_train")), F.lit(True))
    both = df.join(F.broadcast(s.select("span", "tau_train")), F.lit(True))
    near = F.abs(F.col(ts) - F.col("tau_train")) <= F.col("span") * share
    out = both.groupBy(F.col(cls).alias("cls")).agg(F.count("*").alias("n"), F.count_if(near).alias("near"))
    return out.withColumn("density", F.col("near") / (F.col("n") * 2 * share)).withColumn("dense", F.col("density") >= times)


def thin_classes(cover: DataFrame, least: int = 30, share: float = 0.01) -> DataFrame:
    """cls, split, n: classes with fewer than ``least`` rows or less than ``share`` of their rows in a split. [I6]"""
    n = F.col("n_train") + F.col("n_val") + F.col("n_test")
    long = cover.select("cls", n.alias("whole"), F.expr("stack(3, 'train', n_train, 'val', n_val, 'test', n_test) AS (split, n)"))
    return long.filter((F.col("n") < least) | (F.col("n") < F.col("whole") * share)).select("cls", "split", "n")


def window_means(df: DataFrame, value: str, windows: int, kind: str = "equal_time", ts: str = "ts", cls: str = "cls") -> DataFrame:
    """cls, windows, spread: means per chronological sub-window of each class, and their population deviation. [E14]"""
    if kind == "equal_count":
        part = F.ntile(windows).over(W.partitionBy(cls).orderBy(ts, "eid")) - 1
        cut = df.withColumn("_w", part)
    else:
        ends = df.groupBy(F.col(cls).alias("_c")).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
        cut = df.join(F.broadcast(ends), F.col(cls) == F.col("_c")).withColumn("_w", F.least(F.floor((F.col(ts) - F.col("_a")) * windows / F.greatest(F.col("_b") - F.col("_a"), F.lit(1))), F.lit(windows - 1)))
    means = cut.groupBy(F.col(cls).alias("cls"), "_w").agg(F.avg(value).alias("_m"))
    return means.groupBy("cls").agg(F.count("*").alias("windows"), F.stddev_pop("_m").alias("spread"))


def halves(df: DataFrame, value: str, eid: str = "eid", cls: str = "cls") -> DataFrame:
    """cls, first_mean, rest_mean: the first floor(n / 2) rows of each class against the rest. [E15]"""
    n = df.groupBy(cls).agg(F.count("*").alias("_n"))
    r = joined_on(numbered(df.select(cls, eid, value), [eid], [cls], "_r"), n, [cls])
    early = F.col("_r") < F.floor(F.col("_n") / 2)
    return r.groupBy(F.col(cls).alias("cls")).agg(F.avg(F.when(early, F.col(value))).alias("first_mean"), F.avg(F.when(~early, F.col(value))).alias("rest_mean"))
