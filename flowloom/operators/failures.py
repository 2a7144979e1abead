"""Games that can't be played, as data: a poisoned flow is a row with its error, all others are scored. [K6]"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a row's own values can cause. Anything else (memory, a lost worker) fails the task, which Spark repeats.
FAULTS = (ArithmeticError, LookupError, TypeError, ValueError, np.linalg.LinAlgError)


def play_each(rows: DataFrame, key: str, play: Callable, fields: str, errors: bool = False) -> DataFrame:
    """``key`` and the ``fields`` (as DDL) that ``play`` makes of each row, in Arrow batches.

    With ``errors``, a row on which ``play`` raises one of FAULTS has null fields and the fault in the further column ``error``;
    the others have a null error. Without, the fault is raised.
    """
    names = T.StructType.fromDDL(fields).names
    columns = [key, *names, *(["error"] if errors else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                made, fault = [None] * len(names), None
                try:
                    made = play(row)
                except FAULTS as e:
                    if not errors:
                        raise
                    fault = f"{type(e).__name__}: {e}"
                out.append((getattr(row, key), *made, *([fault] if errors else [])))
            # objects: a null in a column of integers doesn't make them floats
            yield pd.DataFrame(out, columns=columns, dtype=object)

    form = f"{key} {rows.schema[key].dataType.simpleString()}, {fields}" + (", error string" if errors else "")
    return rows.mapInPandas(run, form)


def all_finite(x: np.ndarray, names: list) -> np.ndarray:
    """``x``, or a ValueError that names the first row that holds a null, NaN or infinity."""
    bad = ~np.isfinite(x).all(axis=1)
    if bad.any():
        raise ValueError(f"the state of node {names[int(bad.argmax())]} isn't finite")
    return x


def array_fault(x: Column, size: int, name: str) -> Column:
    """Why an array of doubles isn't ``size`` finite numbers; null if it is."""
    bad = F.filter(F.transform(x, lambda v, i: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), i)), lambda i: i.isNotNull())
    out = F.when(x.isNull(), F.lit(f"{name} missing")).when(F.size(x) != size, F.concat(F.lit(f"{name} has "), F.size(x), F.lit(f" values, not {size}")))
    return out.when(F.size(bad) > 0, F.concat(F.lit(f"{name} {{"), F.array_join(bad.cast("array<string>"), ","), F.lit("} not finite")))


def outcomes(played: DataFrame, by: list[str]) -> DataFrame:
    """``by``, error (null: scored), n: how many rows ended how."""
    return played.groupBy(*by, "error").agg(F.count("*").alias("n"))


def watched(played: DataFrame, name: str = "games") -> tuple[DataFrame, Observation]:
    """``played`` and an observation that holds n and failed once an action has run: counts without a further pass."""
    seen = Observation(name)
    return played.observe(seen, F.count(F.lit(1)).alias("n"), F.count("error").alias("failed")), seen
