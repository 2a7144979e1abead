"""Session builder with the settings that every operator assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "flowloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution, shuffle partitions near the core count."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds the bytes of an Arrow batch, for tasks whose rows hold long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):  # the default: a setting of the user's own stays
        spark.conf.set(key, str(most))
