"""Comparisons of attributions with expectations, hop sets, state variants, and small joins on class names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.ranges import joined_on, quantiles, running
from flowloom.operators.splitting import with_split

#: Dimensions of a node's state that no coalition masks.
NEVER_MASKED = (11, 12)


def state_variant(state: Column, kind: str) -> Column:
    """A state vector as an ablation sees it: ``zero`` or its ``first11`` dimensions. [B14]"""
    return {"zero": F.transform(state, lambda v: v * 0), "first11": F.slice(state, 1, 11)}[kind]


def masked_state(state: Column, background: Column, keep: tuple[int, ...] = NEVER_MASKED) -> Column:
    """The background, but for the dimensions that are never masked. [B15]"""
    return F.transform(F.arrays_zip(state.alias("s"), background.alias("b")), lambda p, i: F.when(i.isin(*keep), p["s"]).otherwise(p["b"]))


def relabelled(df: DataFrame, taus: DataFrame, ids: DataFrame) -> DataFrame:
    """``df`` with split and label from thresholds and a label map (name, id); a class that the map lacks is an error. [B16]"""
    unknown = df.select(F.col("cls").alias("name")).distinct().join(ids, "name", "left_anti").limit(1).collect()
    if unknown:
        raise KeyError(unknown[0]["name"])
    return with_split(df, taus).join(F.broadcast(ids.select(F.col("name").alias("cls"), F.col("id").alias("label"))), "cls")


def on_common_classes(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Rows of classes that both sides have and whose ``value`` isn't null. [C16]"""
    return left.join(right, "cls").filter(F.col(value).isNotNull())


def on_own_classes(classes: DataFrame, report: DataFrame) -> DataFrame:
    """Every class of a table, with nulls where the report lacks it. [C17, M23]"""
    return classes.select("cls").join(report, "cls", "left")


def unknown_groups(mapping: DataFrame, known: DataFrame) -> DataFrame:
    """cls, grp of mapping rows that name a group that there is none of. [C18]"""
    return mapping.join(known.select("grp").distinct(), "grp", "left_anti").select("cls", "grp").distinct()


def expected_ranks(ranking: DataFrame, mapping: DataFrame) -> DataFrame:
    """cls, grp, expected: the mapping's rank where it is a number, else the row's position in the mapping, n + 1 where it has none. [M20]

    ``ranking``: cls, grp; ``mapping``: cls, grp, position, expected (text).
    """
    n = ranking.groupBy("cls").agg(F.count("*").alias("_n"))
    named = mapping.select("cls", "grp", F.coalesce(F.col("expected").try_cast("double"), F.col("position").cast("double")).alias("expected"))
    both = ranking.select("cls", "grp").join(named, ["cls", "grp"], "left").join(n, "cls")
    return both.select("cls", "grp", F.coalesce("expected", F.col("_n") + 1.0).alias("expected"))


def three_way_agreement(ours: Column, literature: Column, measured: Column) -> Column:
    """Which of three topologies agree; a missing expectation comes first, then an indeterminate measurement. [D37]"""
    same = {"ours_measured": ours == measured, "ours_literature": ours == literature, "measured_literature": measured == literature}
    out = F.when(literature == "not_supplied", "literature_missing").when(measured == "indeterminate", "measured_indeterminate")
    out = out.when(same["ours_measured"] & same["ours_literature"], "full")
    for name, test in same.items():
        out = out.when(test, name)
    return out.otherwise("none")


def rest_of(n: Column, top: Column) -> Column:
    """Indices 0 to n - 1 that aren't in ``top``. [G3]"""
    every = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: ~F.array_contains(top, i))


def hop_sets(neighbours: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed_eid, hop, node: nodes that sampled edges of hop 1 add to the seed's ends, and those of hop 2 to both. [J12]"""
    ends = seeds.select(F.col("eid").alias("seed_eid"), F.explode(F.array("src", "dst")).alias("node"), F.lit(0).alias("hop"))
    reached = neighbours.select("seed_eid", F.col("src").alias("node"), "hop")
    return ends.unionByName(reached).groupBy("seed_eid", "node").agg(F.min("hop").alias("hop")).filter("hop > 0")


def gateway_report(stats: DataFrame, k: DataFrame) -> DataFrame:
    """The distance statistics of all classes beside the depth that they ask for: one row. [J11]"""
    return stats.filter("cls IS NULL").drop("cls").join(F.broadcast(k), F.lit(True))


def packed_result(df: DataFrame, measured: list[str]) -> DataFrame:
    """Unmeasured values as NaN, never as 0. [M16]"""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in measured})


def is_present(support: Column) -> Column:
    """Null-safe: whether a class occurs. [M27]"""
    return F.coalesce(support, F.lit(0)) > 0


def is_significant(p: Column, level: float = 0.05) -> Column:
    """Null-safe: whether a p-value is below the level; unknown is not significant. [M27]"""
    return F.coalesce(~F.isnan(p) & (p < level), F.lit(False))


def roc_curve(rows: DataFrame) -> DataFrame:
    """cls, score, tpr, fpr: the curve at each distinct score, from the highest down; null rates where a side is empty. [D12]

    ``rows``: cls, score, positive. Scores are counted first and summed over ranges.
    """
    counts = rows.groupBy("cls", (-F.col("score")).alias("_down")).agg(F.count_if("positive").cast("long").alias("_p"), F.count_if(~F.col("positive")).cast("long").alias("_f"))
    up = running(running(counts, F.col("_p"), ["_down"], ["cls"], "_tp"), F.col("_f"), ["_down"], ["cls"], "_fp")
    totals = counts.groupBy("cls").agg(F.sum("_p").alias("_all_p"), F.sum("_f").alias("_all_f"))
    rate = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole))
    return joined_on(up, totals, ["cls"]).select("cls", (-F.col("_down")).alias("score"), rate("_tp", "_all_p").alias("tpr"), rate("_fp", "_all_f").alias("fpr"))


def runtime_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, mean, std, median, p95 of a runtime. [D18]"""
    return joined_on(rows.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")), quantiles(rows, value, {"median": 0.5, "p95": 0.95}, [by]), [by])
