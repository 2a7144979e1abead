"""Global row numbers in time order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowloom.operators.ranges import numbered


def with_eid(df: DataFrame, ts: str = "ts", ties: tuple[str, ...] = (), name: str = "eid") -> DataFrame:
    """Adds ``name``: 0 to n - 1 by (ts, ties). [E6, F1]

    Rows are dealt to ranges of (ts, ties), so a day of very many ties is spread as well. ``ties`` must make the order total.
    """
    return numbered(df, [ts, *ties], name=name)
