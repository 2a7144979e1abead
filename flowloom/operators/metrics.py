"""Classification metrics over (truth, predicted[, probabilities]) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(rows: DataFrame) -> DataFrame:
    """truth, predicted, n. [D9]"""
    return rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def per_class(rows: DataFrame) -> DataFrame:
    """cls, support, predicted, hits, precision, recall, f1 of every class in truth or predictions; 0 where undefined. [D9]"""
    c = confusion(rows)
    sides = c.select(F.col("truth").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("h")).union(
        c.select("predicted", F.lit(0).cast("long"), "n", F.lit(0).cast("long"))
    )
    s = sides.groupBy("cls").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    s = s.withColumn("precision", ratio("hits", "predicted")).withColumn("recall", ratio("hits", "support"))
    return s.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def summary(rows: DataFrame, class_universe: str = "truth") -> DataFrame:
    """One row: accuracy, macro_f1, weighted_f1. Macro runs over classes in ``truth``, or over the 'union' with predictions. [D9, D10]"""
    s = per_class(rows)
    inside = F.col("support") > 0 if class_universe == "truth" else F.lit(True)
    return s.agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg(F.when(inside, F.col("f1"))).alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def minority_summary(rows: DataFrame, train_counts: DataFrame, below: int, alpha: float) -> DataFrame:
    """One row: macro_f1, minority_f1 (classes with fewer than ``below`` training rows), composite. [D11]"""
    s = per_class(rows).filter("support > 0").join(train_counts.select("cls", "n_train"), "cls", "left")
    small = F.coalesce(F.col("n_train"), F.lit(0)) < below
    out = s.agg(F.avg("f1").alias("macro_f1"), F.avg(F.when(small, F.col("f1"))).alias("minority_f1"))
    return out.withColumn("composite", (1 - alpha) * F.col("macro_f1") + alpha * F.coalesce("minority_f1", "macro_f1"))


def denominators(scores: DataFrame, closed: DataFrame, n_classes: int) -> DataFrame:
    """One row: the macro over the full label space (absent classes 0), over classes with support, and over the closed set. [D28, M19]"""
    marked = scores.join(closed.select("cls", F.lit(True).alias("_in")), "cls", "left")
    return marked.agg(
        (F.sum(F.when(F.col("support") > 0, F.col("f1")).otherwise(0.0)) / n_classes).alias("macro_full"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_supported"),
        F.avg(F.when((F.col("support") > 0) & F.col("_in"), F.col("f1"))).alias("macro_closed"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """cls, positives, auc: one against the rest, from (cls, score, positive) rows; null where a side is empty. [D12]

    Rows of equal score are one step. Scores are counted per (class, score) first; the running sums go over those.
    """
    steps = scored.groupBy("cls", "score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("n"))
    before = W.partitionBy("cls").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    area = steps.withColumn("above", F.coalesce(F.sum("p").over(before), F.lit(0)))
    out = area.groupBy("cls").agg(F.sum("p").alias("positives"), F.sum("n").alias("_n"), F.sum(F.col("n") * (F.col("above") + F.col("p") / 2)).alias("_a"))
    return out.select("cls", "positives", F.when((F.col("positives") > 0) & (F.col("_n") > 0), F.col("_a") / (F.col("positives") * F.col("_n"))).alias("auc"))
