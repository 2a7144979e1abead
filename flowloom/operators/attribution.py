"""Tables from stored attributions: rows (eid, cls, predicted, groups, phi, ...), one per explained edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def long_form(records: DataFrame) -> DataFrame:
    """eid, cls, grp, place, phi: a row per group of each record. [D27]"""
    return records.select("eid", "cls", F.posexplode(F.arrays_zip("groups", "phi")).alias("place", "p")).select("eid", "cls", "place", F.col("p.groups").alias("grp"), F.col("p.phi").alias("phi"))


def class_profiles(records: DataFrame) -> DataFrame:
    """cls, grp, mean_abs, place: mean |phi| and its rank within the class, names break ties. [D27, E12]"""
    means = long_form(records).groupBy("cls", "grp").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    return means.withColumn("place", F.row_number().over(W.partitionBy("cls").orderBy(F.col("mean_abs").desc(), "grp")))


def concentration(profiles: DataFrame, share: float = 0.8) -> DataFrame:
    """cls, n: the fewest groups whose mean |phi| reaches ``share`` of the total; all of them if the total is 0. [E11]"""
    ranked = W.partitionBy("cls").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    p = profiles.withColumn("_t", F.sum("mean_abs").over(W.partitionBy("cls"))).withColumn("_c", F.sum("mean_abs").over(ranked))
    reach = F.when((F.col("_t") > 0) & (F.col("_c") >= F.col("_t") * share - 1e-12), F.col("place"))
    return p.groupBy("cls").agg(F.coalesce(F.min(reach), F.count("*").cast("int")).alias("n"))


def top_group(records: DataFrame) -> DataFrame:
    """cls, top1, times: the group that is strongest most often, names break ties. [M28]"""
    first = long_form(records).withColumn("_r", F.row_number().over(W.partitionBy("eid").orderBy(F.abs("phi").desc(), "place"))).filter("_r = 1")
    counts = first.groupBy("cls", "grp").agg(F.count("*").alias("times"))
    best = counts.withColumn("_r", F.row_number().over(W.partitionBy("cls").orderBy(F.col("times").desc(), "grp")))
    return best.filter("_r = 1").select("cls", F.col("grp").alias("top1"), "times")


def most_negative(records: DataFrame) -> DataFrame:
    """cls, grp, mean_phi: the group of the least mean signed phi. [M29]"""
    means = long_form(records).groupBy("cls", "grp").agg(F.avg("phi").alias("mean_phi"))
    return means.withColumn("_r", F.row_number().over(W.partitionBy("cls").orderBy("mean_phi", "grp"))).filter("_r = 1").drop("_r")


def stability(runs: DataFrame) -> DataFrame:
    """cls, mean_std, max_std: deviation of each group's phi over seeds, mean and max per edge, then mean and max per class. [D16, D29]"""
    per = runs.groupBy("cls", "eid", "grp").agg(F.stddev_pop("phi").alias("s"))
    flows = per.groupBy("cls", "eid").agg(F.avg("s").alias("m"), F.max("s").alias("x"))
    return flows.groupBy("cls").agg(F.avg("m").alias("mean_std"), F.max("x").alias("max_std"))


def fidelity_summary(rows: DataFrame) -> DataFrame:
    """cls (null: overall), n, means and deviations of fidelity, mean runtime without negatives. [D13, D18]"""
    runtime = F.when(F.col("runtime_s") >= 0, F.col("runtime_s"))
    return rows.rollup("cls").agg(
        F.count("*").alias("n"), F.round(F.avg("fidelity_plus"), 4).alias("mean_plus"), F.round(F.stddev_pop("fidelity_plus"), 4).alias("std_plus"),
        F.round(F.avg("fidelity_minus"), 4).alias("mean_minus"), F.round(F.stddev_pop("fidelity_minus"), 4).alias("std_minus"), F.round(F.avg(runtime), 4).alias("mean_runtime"),
    )


def temporal_summary(rows: DataFrame, k: int = 3) -> DataFrame:
    """cls (null: overall): fidelity over flows with neighbours, and over those with more than k; mean count over all. [D14, D15]"""
    some, many = F.col("n_neighbours") >= 1, F.col("n_neighbours") > k
    return rows.rollup("cls").agg(
        F.avg("n_neighbours").alias("mean_n"), F.count_if(some).alias("n_nonempty"), F.avg(F.when(some, F.col("fidelity_plus"))).alias("plus_nonempty"),
        F.count_if(many).alias("n_informative"), F.avg(F.when(many, F.col("fidelity_minus"))).alias("minus_informative"),
    )


def novelty_summary(rows: DataFrame, k: int = 3) -> DataFrame:
    """cls (null: overall), n, with_novelty, share; the same of flows with more than ``k`` players; mean fidelities of these. [D15]

    ``rows``: cls, n_players, novelty_in_top (novelty players among the k strongest), fidelity_plus, fidelity_minus.
    """
    many, novel = F.col("n_players") > k, F.col("novelty_in_top") > 0
    return rows.rollup("cls").agg(
        F.count("*").alias("n"), F.count_if(novel).alias("with_novelty"), F.avg(novel.cast("double")).alias("share"),
        F.count_if(many).alias("n_informative"), F.count_if(many & novel).alias("with_novelty_informative"), F.avg(F.when(many, novel.cast("double"))).alias("share_informative"),
        F.avg(F.when(many, F.col("fidelity_plus"))).alias("mean_plus"), F.avg(F.when(many, F.col("fidelity_minus"))).alias("mean_minus"),
    )


def efficiency_audit(rows: DataFrame) -> DataFrame:
    """cls (null: overall), mean_err, max_err, pass_rate, mean_rel: |sum phi - (value - base)| against max(0.1 |gap|, 1e-3). [D20]"""
    gap = F.col("value") - F.col("base")
    err = F.abs(F.aggregate("phi", F.lit(0.0), lambda a, x: a + x) - gap)
    e = rows.select("cls", err.alias("err"), gap.alias("gap"))
    return e.rollup("cls").agg(
        F.avg("err").alias("mean_err"), F.max("err").alias("max_err"), F.avg((F.col("err") <= F.greatest(0.1 * F.abs("gap"), F.lit(1e-3))).cast("double")).alias("pass_rate"),
        F.avg(F.col("err") / F.greatest(F.abs("gap"), F.lit(1e-6))).alias("mean_rel"),
    )


def firing_table(rows: DataFrame) -> DataFrame:
    """cls (null: overall), n, any, both, fired, any_fraction: novelty attribution above 1e-6 at either or both ends. [D21, D24, H19]"""
    s, d = F.abs("src_phi") > 1e-6, F.abs("dst_phi") > 1e-6
    return rows.rollup("cls").agg(
        F.count("*").alias("n"), F.count_if(s | d).alias("any_unseen"), F.count_if(s & d).alias("both_unseen"), F.coalesce(F.avg((s | d).cast("double")), F.lit(0.0)).alias("any_fraction"),
    )


def node_table(nodes: DataFrame, kind: str = "kind", name: str = "name") -> DataFrame:
    """kind, n, names in order. [D22]"""
    return nodes.groupBy(kind).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(name)).alias("names"))


def dimension_audit(states: DataFrame, dims: list[str]) -> DataFrame:
    """dim, mean, max, nonzero, fraction. [D23]"""
    long = states.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("v")) for d in dims])).alias("x")).select("x.*")
    return long.groupBy("dim").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.count_if(F.col("v") != 0).alias("nonzero"), F.avg((F.col("v") != 0).cast("double")).alias("fraction"))


def topology(pairs: DataFrame, fan: float = 3.0, share: float = 0.5) -> DataFrame:
    """cls, dst_per_src, src_per_dst, modal_share, kind: fan_out, fan_in, persistent or other, first rule wins. [D25]"""
    per = pairs.groupBy("cls", "src", "dst").agg(F.count("*").alias("n"))
    s = per.groupBy("cls", "src").agg(F.count("*").alias("k")).groupBy("cls").agg(F.avg("k").alias("dst_per_src"))
    d = per.groupBy("cls", "dst").agg(F.count("*").alias("k")).groupBy("cls").agg(F.avg("k").alias("src_per_dst"))
    m = per.groupBy("cls").agg((F.max("n") / F.sum("n")).alias("modal_share"))
    kind = F.when((F.col("dst_per_src") >= fan) & (F.col("dst_per_src") > F.col("src_per_dst")), "fan_out").when((F.col("src_per_dst") >= fan) & (F.col("src_per_dst") > F.col("dst_per_src")), "fan_in")
    return s.join(d, "cls").join(m, "cls").withColumn("kind", kind.when(F.col("modal_share") >= share, "persistent").otherwise("other"))


def decomposition(records: DataFrame, parts: list[str]) -> DataFrame:
    """cls and the mean share of sum |phi| in each part; a total of 0 counts as 1. [D30]"""
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.abs(x))
    sums = records.select("cls", *[size(c).alias(c) for c in parts])
    total = sum(F.col(c) for c in parts)
    return sums.groupBy("cls").agg(*[F.avg(F.col(c) / F.when(total > 0, total).otherwise(1.0)).alias(f"{c}_share") for c in parts])


def presence_breakdown(rows: DataFrame) -> DataFrame:
    """present, correct (null: either), n, median, spread of fidelity. [D32, D33]"""
    flags = rows.select((F.col("fidelity_plus") > 0).alias("present"), (F.col("truth") == F.col("predicted")).alias("correct"), "fidelity_plus")
    return flags.cube("present", "correct").agg(F.count("*").alias("n"), F.percentile("fidelity_plus", F.lit(0.5)).alias("median"), F.stddev_pop("fidelity_plus").alias("spread"))


def absence(rows: DataFrame) -> DataFrame:
    """cls, n, fraction of fidelity at or below 0, and its standard error. [D34]"""
    low = (F.col("fidelity_plus") <= 0).cast("double")
    return rows.groupBy("cls").agg(F.count("*").alias("n"), F.avg(low).alias("fraction"), (F.stddev_samp(low) / F.sqrt(F.count("*"))).alias("sem"))


def affinity(profiles: DataFrame, groups: list[str]) -> DataFrame:
    """cls and a column per group: mean |phi| over the class's total. [D31]"""
    wide = profiles.groupBy("cls").pivot("grp", groups).agg(F.first("mean_abs"))
    total = sum(F.coalesce(F.col(g), F.lit(0.0)) for g in groups)
    return wide.select("cls", *[(F.coalesce(F.col(g), F.lit(0.0)) / F.when(total > 0, total).otherwise(1.0)).alias(g) for g in groups])


def curated(rows: DataFrame) -> DataFrame:
    """cls, eid, how: the correct flow of most confidence, then magnitude, then least eid; classes without one take the most confident. [F8, F9]"""
    good = rows.filter((F.col("truth") == F.col("predicted")) & (F.col("magnitude") > 1e-6))
    best = good.withColumn("_r", F.row_number().over(W.partitionBy("cls").orderBy(F.col("confidence").desc(), F.col("magnitude").desc(), "eid"))).filter("_r = 1").select("cls", "eid", F.lit("curated").alias("how"))
    rest = rows.join(best.select("cls"), "cls", "left_anti").withColumn("_r", F.row_number().over(W.partitionBy("cls").orderBy(F.col("confidence").desc(), "eid"))).filter("_r = 1")
    return best.unionByName(rest.select("cls", "eid", F.lit("fallback").alias("how")))


def exactness(rows: DataFrame, samples: int) -> DataFrame:
    """cls, flows, mean_players, exhaustive: P = nodes + 2, live players without degenerate and dummy ones. [D36]"""
    p = F.col("n_nodes") + 2 - F.col("n_degenerate") - F.col("n_dummy")
    full = (p <= 1) | ((p <= 30) & (F.pow(F.lit(2.0), p) - 2 <= samples))
    return rows.groupBy("cls").agg(F.count("*").alias("flows"), F.avg(p).alias("mean_players"), F.count_if(full).alias("exhaustive"))


def edge_to_node_scores(edges: DataFrame, signed: bool = False) -> DataFrame:
    """seed_eid, node, score: each edge's |phi| (or phi) added to both ends. [H17]"""
    v = F.col("phi") if signed else F.abs("phi")
    return edges.select("seed_eid", F.explode(F.array("src", "dst")).alias("node"), v.alias("v")).groupBy("seed_eid", "node").agg(F.sum("v").alias("score"))


def group_importance(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """eid, grp, importance: |score| summed over each group's columns. [H16]"""
    each = scores.select("eid", F.posexplode("scores").alias("idx", "s"))
    return each.join(groups, "idx").groupBy("eid", "grp").agg(F.sum(F.abs("s")).alias("importance"))


def attribution_state(phi):
    """all_zero, saturated (all below 1e-12) or null for an array of attributions. [H18]"""
    none = F.lit(None).cast("string")
    return F.when(F.size(phi) == 0, none).when(F.forall(phi, lambda v: v == 0), "all_zero").when(F.forall(phi, lambda v: F.abs(v) < 1e-12), "saturated").otherwise(none)


def long_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value: nulls stay. [M18]"""
    return wide.unpivot(keys, metrics, "metric", "value")


def improvement(per_class: DataFrame, reference: DataFrame) -> DataFrame:
    """cls, value, other, delta, improved. [C19, M38]"""
    return per_class.join(reference, "cls").select("cls", "value", "other", (F.col("value") - F.col("other")).alias("delta"), (F.col("value") > F.col("other")).alias("improved"))


def band(value, low: float, high: float):
    """stable, moderate or unstable. [M39, M35]"""
    return F.when(value <= low, "stable").when(value <= high, "moderate").when(value.isNotNull(), "unstable")
