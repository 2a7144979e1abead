"""Stored artifacts: state tables with their mode, explanation records, catalogs of runs, reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators.samples import bottom_k


def save_state(events: DataFrame, path: str, novelty_mode: str) -> None:
    """Node events with the mode that they were made for. [A7, A8]"""
    events.withColumn("novelty_mode", F.lit(novelty_mode)).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, expected_mode: str) -> DataFrame:
    """The node events; raises if they were made for another mode. A table without a mode counts as recent_window. [A7]"""
    rows = spark.read.parquet(path)
    first = rows.select("novelty_mode").head(1) if "novelty_mode" in rows.columns else []
    mode = first[0]["novelty_mode"] if first else "recent_window"
    if mode != expected_mode:
        raise ValueError(f"the state was built for {mode}, not {expected_mode}")
    return rows.drop("novelty_mode")


def write_records(records: DataFrame, path: str) -> None:
    """Explanation records as JSON, a folder per class. [A11]"""
    records.withColumn("class_name", F.col("cls")).drop("cls").write.partitionBy("class_name").mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of all class folders; files of repaired runs (``*_fixed``) are skipped, absent fields are null. [A12, A15, B12, H26]"""
    rows = spark.read.option("basePath", path).schema(schema).json(f"{path}/class_name=*").withColumn("_file", F.input_file_name())
    return rows.filter(~F.col("_file").rlike(r"_fixed(/|\.json)")).drop("_file").withColumnRenamed("class_name", "cls")


def sample_per_class(records: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` records of each class by a seeded digest; 0 means all. [A13, F6, F10]"""
    return bottom_k(records, n, ["cls"], "eid", seed)


def merge_csv(spark: SparkSession, path: str, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of an earlier result that ``fresh`` doesn't replace, and ``fresh``. [A14]"""
    old = spark.read.option("header", True).schema(fresh.schema).csv(path)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


RUN_NAME = re.compile(r"^(?P<dataset>[a-z0-9_]+?)(?:__(?P<tag>[A-Za-z0-9-]+))?$")


def parse_run_name(name: str) -> dict[str, str | None]:
    """dataset and tag of a run folder's name. [A16]"""
    found = RUN_NAME.match(name)
    if not found:
        raise ValueError(f"not a run name: {name}")
    return found.groupdict()


def resolve_dataset(runs: dict[str, bool], wanted: str) -> str:
    """The only complete run whose name begins with ``wanted``; ambiguity is an error. [A16, M26]"""
    hits = [r for r, complete in sorted(runs.items()) if complete and r.startswith(wanted)]
    if wanted in hits:
        return wanted
    if len(hits) != 1:
        raise ValueError(f"{wanted} fits {hits or 'no complete run'}")
    return hits[0]


def merged_config(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``, nested dictionaries merged. [§1.1, M12, M13]"""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small report table; more than ``most`` rows are an error, not cut. [A18]"""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in rows])


def fingerprint(payload: dict) -> str:
    """SHA-256 of canonical JSON: what a stored result was made from. [A19, H28]"""
    import hashlib

    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
