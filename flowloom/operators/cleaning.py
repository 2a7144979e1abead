"""Ingest cleaning: duplicates, required columns, infinities, medians, casts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.ranges import quantiles


def check_label_columns(df: DataFrame, names: tuple[str, str] = ("Label", "Attack")) -> DataFrame:
    """Raises unless the last two columns are the label columns. [B7]"""
    if tuple(df.columns[-2:]) != names:
        raise ValueError(f"the last columns are {df.columns[-2:]}, not {list(names)}")
    return df


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Rows equal in all columns, nulls included, once. [B1]"""
    return df.dropDuplicates()


def drop_incomplete(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows without nulls in the required columns. [B2]"""
    return df.na.drop(subset=required)


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """[B3]"""
    return df.na.fill(0.0, columns)


def infinities_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite and NaN values become null. [B4]"""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return df.withColumns({c: finite(c) for c in columns})


def impute_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the exact median of the column over the whole table, found for all columns at once, over ranges of their values. [B5]"""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    found = quantiles(long, "value", {"median": 0.5}, ["name"])
    medians = found.agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(f"_{c}") for c in columns])
    joined = df.join(F.broadcast(medians), F.lit(True))  # one row
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else c for c in df.columns])


def to_number(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers, 0 for what isn't one. [B6]"""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns})


def clean(df: DataFrame, required: list[str], zero: list[str], numeric: list[str]) -> DataFrame:
    """The chain in the order that decides its result: B1, B2, B3, B4, B5. [A1]"""
    out = drop_incomplete(drop_duplicates(df), required)
    return impute_medians(infinities_to_null(fill_zero(out, zero), numeric), numeric)


def unknown_classes(df: DataFrame, label: str, known: DataFrame) -> DataFrame:
    """The classes that ``known`` (column ``name``) lacks, with their row counts. [B13]"""
    seen = df.groupBy(F.col(label).alias("name")).agg(F.count("*").alias("n"))
    return seen.join(known.select("name"), "name", "left_anti")


def require_known_classes(df: DataFrame, label: str, known: DataFrame) -> DataFrame:
    """``df``, or an error that names the unknown classes (their number is bounded by the label vocabulary)."""
    if missing := [r["name"] for r in unknown_classes(df, label, known).collect()]:
        raise ValueError(f"unknown classes: {sorted(map(str, missing))}")
    return df


def label_map(df: DataFrame, label: str, benign: str) -> DataFrame:
    """name, id: the benign class is 0 and must exist, others follow in alphabetical order. [§1.2, A8, C2]"""
    from pyspark.sql import Window as W

    names = df.select(F.col(label).alias("name")).distinct()
    return names.select("name", (F.dense_rank().over(W.orderBy(F.col("name") != benign, "name")) - 1).cast("int").alias("id"))
