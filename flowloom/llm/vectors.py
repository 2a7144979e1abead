"""Vector columns: which rows take part, and their numbers as matrices inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector of at least one entry, all of them numbers: no null, NaN or infinity."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & ~F.exists(vector, bad)


def common_length(lengths: DataFrame) -> tuple[int, int]:
    """The length that most rows have (the longer of equals) and how many have it, from rows of (d, n); (0, 0) without rows."""
    found = lengths.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return (int(found["d"]), int(found["n"])) if found else (0, 0)


def matrix(vectors: pa.Array, d: int) -> np.ndarray:
    """A row per vector, in double precision."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), d)


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same rows in pieces of ``rows`` (the last one may be smaller)."""
    held, n = [], 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, rows - n)
            held.append(part)
            n, batch = n + len(part), batch.slice(len(part))
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
