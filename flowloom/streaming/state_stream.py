"""Structured Streaming variants: rolling node state by event time, and tumbling class counts.

The batch operators have no streaming counterpart to match; tests hold these against the batch results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "node long, ts timestamp, in_degree long, out_degree long, in_bytes double, out_bytes double"


def class_counts(flows: DataFrame, every: str = "1 hour", late: str = "2 hours", at: str = "at") -> DataFrame:
    """window, cls, n over a stream of flows with a timestamp column; rows later than ``late`` are dropped. [I3]"""
    windowed = flows.withWatermark(at, late).groupBy(F.window(at, every), "cls").agg(F.count("*").alias("n"))
    return windowed.select(F.col("window.start").alias("start"), "cls", "n")


def rolling_counts(events: DataFrame, window_ms: int, late: str = "1 hour") -> DataFrame:
    """For each incoming node event the state of its node over [t - window, t]: a keyed state that keeps no more than a window. [E1]

    ``events``: node, at (timestamp), incoming, bytes. State is evicted by event time; within a micro-batch events are taken
    in time order, so results equal the batch operator's where no event comes later than its successors.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        times, inc, sizes = map(list, kept.get) if kept.exists else ([], [], [])
        new = pd.concat(list(frames)).sort_values("at", kind="stable")
        times += [int(t.value // 1_000_000) for t in new["at"]]
        inc += [bool(x) for x in new["incoming"]]
        sizes += [float(x) for x in new["bytes"]]
        order = sorted(range(len(times)), key=times.__getitem__)
        rows, fresh = [], {int(t.value // 1_000_000) for t in new["at"]}
        for t in sorted(fresh):
            inside = [i for i in order if t - window_ms <= times[i] <= t]
            rows.append((key[0], pd.Timestamp(t, unit="ms"), sum(inc[i] for i in inside), sum(not inc[i] for i in inside), sum(sizes[i] for i in inside if inc[i]), sum(sizes[i] for i in inside if not inc[i])))
        last = max(times)
        keep = [i for i in order if times[i] >= last - window_ms]
        kept.update(([times[i] for i in keep], [inc[i] for i in keep], [sizes[i] for i in keep]))
        kept.setTimeoutTimestamp(max(last + window_ms, kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["node", "ts", "in_degree", "out_degree", "in_bytes", "out_bytes"])

    return events.withWatermark("at", late).groupBy("node").applyInPandasWithState(update, STATE, "times array<long>, inc array<boolean>, sizes array<double>", "append", GroupStateTimeout.EventTimeTimeout)
