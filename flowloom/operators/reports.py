"""Comparisons and report tables over stored results, and the pruning of correlated columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.operators.ranges import ranked_values
from flowloom.plans.scratch import written


def correct(records: DataFrame) -> DataFrame:
    """The records whose prediction is the true label. [B11]"""
    return records.filter(F.col("truth") == F.col("predicted"))


def with_default_score(edges: DataFrame, scores: DataFrame, key: str = "eid") -> DataFrame:
    """``edges`` with phi of ``scores``, 0.0 where an edge has none. [C14]"""
    return edges.join(scores.select(key, "phi"), key, "left").withColumn("phi", F.coalesce("phi", F.lit(0.0)))


def mismatches(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, left, right: values as text in which two tables differ, null equal to null only. [C20, G9]"""
    both = a.select(key, *[F.col(c).cast("string").alias(f"{c}_l") for c in columns]).join(b.select(key, *[F.col(c).cast("string").alias(f"{c}_r") for c in columns]), key)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_l").alias("left"), F.col(f"{c}_r").alias("right")) for c in columns]))
    return both.select(key, cells.alias("x")).select(key, "x.*").filter(~F.col("left").eqNullSafe(F.col("right")))


def method_table(rows: DataFrame) -> DataFrame:
    """method, cls (null: all classes), n, plus, minus: mean fidelities of each method. [D19]"""
    done = rows.rollup("method", "cls").agg(F.count("*").alias("n"), F.avg("fidelity_plus").alias("plus"), F.avg("fidelity_minus").alias("minus"))
    return done.filter("method IS NOT NULL")


def stage_topology(counts: DataFrame, fan: float = 3.0) -> DataFrame:
    """cls, topology from n_src and n_dst of each class: the rules hold in order, and classes that all agree say nothing. [D26]"""
    same = counts.agg((F.countDistinct("n_src", "n_dst") <= 1).alias("_same"), (F.count("*") > 1).alias("_many"))  # one row
    s, d = F.col("n_src"), F.col("n_dst")
    unknown = F.coalesce((s <= 0) | (d <= 0), F.lit(True))
    kind = (
        F.when(unknown, "indeterminate").when(F.col("_same") & F.col("_many"), "indeterminate_identical").when(s >= fan * d, "fan_in").when(d >= fan * s, "fan_out")
        .when((s == 1) & (d == 1), "persistent").otherwise("other")
    )
    return counts.join(F.broadcast(same), F.lit(True)).select("cls", kind.alias("topology"))


def case_quality(records: DataFrame) -> DataFrame:
    """eid, top_phi, phi_range: the largest |phi| of a record and how far the smallest is below it. [D38]"""
    size = F.transform("phi", F.abs)
    return records.select("eid", F.array_max(size).alias("top_phi"), (F.array_max(size) - F.array_min(size)).alias("phi_range"))


def largest_change(full: Column, empty: Column) -> Column:
    """The largest change of any logit between two arrays; null, not 0, where it was not measured. [J20]"""
    return F.array_max(F.zip_with(full, empty, lambda a, b: F.abs(a - b)))


def unit_scaled(rows: DataFrame, value: str, by: str) -> DataFrame:
    """``rows`` with ``scaled``: the value from 0 to 1 within its group, 0.5 where the group is constant. [H20]"""
    ends = rows.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    return rows.join(ends, by).withColumn("scaled", scaled).drop("_lo", "_hi")


def piped(names: Column) -> Column:
    """An array as text, parts divided by bars. [H25]"""
    return F.concat_ws("|", names)


def parsed(text: Column) -> Column:
    """The parts of such a text, trimmed; none for empty or null texts. [H25]"""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def split_continuity(rows: DataFrame, order: list[str], key: str = "eid", split: str = "split") -> DataFrame:
    """split, n, first, last, gapless, follows: whether each split holds a gapless range of ids that starts where the one before ends. [G8]"""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(split))
    ranges = rows.groupBy(split).agg(F.count("*").alias("n"), F.countDistinct(key).alias("_d"), F.min(key).alias("first"), F.max(key).alias("last"))
    before = F.lag("last", 1, -1).over(W.orderBy(place))  # a row per split
    return ranges.select(split, "n", "first", "last", ((F.col("last") - F.col("first") + 1 == F.col("n")) & (F.col("_d") == F.col("n"))).alias("gapless"), (F.col("first") == before + 1).alias("follows"))


def ablation_table(scores: DataFrame, base: str) -> DataFrame:
    """variant, score, delta: the score of each variant less that of ``base``. [J18]"""
    own = scores.filter(F.col("variant") == base).agg(F.max("score").alias("_base"))  # one row
    return scores.join(F.broadcast(own), F.lit(True)).select("variant", "score", (F.col("score") - F.col("_base")).alias("delta"))


def rank_correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, rho: Spearman's correlation of each pair of columns, x before y; null where one is constant. [H5]

    Only distinct values are ranked. Equal rows are counted first, and each distinct row looks its values' ranks up, column by
    column: rows need no key, aren't taken apart and put together again, and a column of few values is broadcast.
    """
    distinct = written(rows.groupBy(*[F.col(c).cast("double").alias(c) for c in columns]).agg(F.count("*").alias("_rows")), "distinct")
    ranked = distinct
    for c in columns:
        values = ranked_values(distinct.withColumnRenamed(c, "_value"), "_value", weight="_rows")
        ranks = written(values.select(F.col("_value").alias(c), (F.col("upto") - (F.col("n") - 1) / 2).alias(f"_rank_{c}")), "ranks")
        ranked = ranked.join(ranks, c, "left")
    rank = lambda c: F.col(f"_rank_{c}")
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    centre = ranked.agg(*[F.floor(F.sum(rank(c) * F.col("_rows")) / F.sum(F.when(rank(c).isNotNull(), F.col("_rows")))).alias(f"_mid_{c}") for c in columns])  # one row
    mid = ranked.join(F.broadcast(centre), F.lit(True))

    def rho(x: str, y: str) -> Column:
        both = F.col("_rows") * F.when(rank(x).isNotNull() & rank(y).isNotNull(), 1.0)
        a, b = rank(x) - F.col(f"_mid_{x}"), rank(y) - F.col(f"_mid_{y}")
        n, sx, sy = F.sum(both), F.sum(both * a), F.sum(both * b)
        spread = lambda v, s: F.sum(both * v * v) - s * s / n
        p = spread(a, sx) * spread(b, sy)
        varies = lambda v: F.max(F.when(both > 0, v)) > F.min(F.when(both > 0, v))
        return F.when(varies(a) & varies(b) & (p > 0), (F.sum(both * a * b) - sx * sy / n) / F.sqrt(p))

    found = mid.agg(*[rho(x, y).alias(f"{x}|{y}") for x, y in pairs])
    return found.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"`{x}|{y}`").alias("rho")) for x, y in pairs])).alias("p")).select("p.*")


def pruned_columns(correlations: DataFrame, columns: list[str], threshold: float = 0.995) -> list[str]:
    """The columns that stay: each is held, in order, against those that stay before it. [H5]"""
    near = {(r["x"], r["y"]) for r in correlations.filter(F.abs("rho") > threshold).collect()}  # pairs of columns
    stay: list[str] = []
    for c in columns:
        if not any((s, c) in near for s in stay):
            stay.append(c)
    return stay
