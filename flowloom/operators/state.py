"""Rolling per-node state over closed event-time windows [t - W, t].

A node's events are cut into time slices; each slice also carries the events of the last W before it, so every window lies
within one slice. A hot node is thereby spread over tasks, and an event is copied at most once when slices are longer than W.

Within a slice each event is added when it happens and taken off when it leaves the window, so every dimension is a running
sum: work and memory a row don't depend on how many events a window holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.functions.encode import N_BINS, entropy, season
from flowloom.operators.ranges import counts_upto, numbered
from flowloom.plans.scratch import written

#: A slice is this many windows long.
SLICE_WINDOWS = 16
#: Events of a sweep's task, about.
SWEEP_ROWS = 100_000


def sliced(events: DataFrame, window: int, ts: str = "ts") -> DataFrame:
    """Adds slice and core: each event in its own slice (core) and, within ``window`` of the next slice's start, there too."""
    long = window * SLICE_WINDOWS
    own = F.floor(F.col(ts) / long)
    last = F.floor((F.col(ts) + window) / long)
    return events.withColumn("slice", F.explode(F.sequence(own, last))).withColumn("core", F.col("slice") == own)


def sweep_parts(events: DataFrame) -> int:
    """How many tasks sweep ``events``: it grows with the table, so a task's sorts don't."""
    return max(events.sparkSession.sparkContext.defaultParallelism, -(-events.count() // SWEEP_ROWS))


def hourly_baselines(events: DataFrame) -> DataFrame:
    """node, hour, mean of log1p(max(0, bytes)), and the mean over all values (global_mean). [D1]"""
    value = F.log1p(F.greatest(F.col("bytes"), F.lit(0.0)))
    hour = F.floor(F.pmod(F.col("ts") / 3_600_000, F.lit(24.0))).cast("int")
    per = events.select("node", hour.alias("hour"), value.alias("v")).groupBy("node", "hour").agg(F.avg("v").alias("baseline"), F.sum("v").alias("_s"), F.count("v").alias("_n"))
    whole = per.agg((F.sum("_s") / F.sum("_n")).alias("global_mean"))
    return per.drop("_s", "_n").join(F.broadcast(whole), F.lit(True))


def first_seen(events: DataFrame) -> DataFrame:
    """node, first_seen. [E4]"""
    return events.groupBy("node").agg(F.min("ts").alias("first_seen"))


def in_reach(events: DataFrame, probes: DataFrame, window: int) -> DataFrame:
    """``events`` that may lie in [t - window, t] of a probe (node, ts): those in the quarters of a window that it touches, each once.

    What a window holds, and what comes before and after within it, is the same as among all events.
    """
    step = max(1, window // 4)
    quarter = lambda t: F.floor(t / step)
    touched = probes.select(F.col("node").alias("_node"), F.explode(F.sequence(quarter(F.col("ts") - window), quarter(F.col("ts")))).alias("_quarter")).distinct()
    return events.join(touched, F.col("node").eqNullSafe(F.col("_node")) & (quarter(F.col("ts")) == F.col("_quarter")), "left_semi")


def _window(window: int):
    return W.partitionBy("node", "slice").orderBy("ts").rangeBetween(-window, 0)


def rolling_state(events: DataFrame, window: int, probes: DataFrame | None = None, baselines: DataFrame | None = None, internal: Column | None = None, trained: DataFrame | None = None, counters: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """The 15 dimensions at each probe (node, t), or at each event's own node and time. [E1, E2, C7, C9, C10, D1]

    Probes join the events as marked rows of the same order instead of a range join. ``trained`` (nodes of the training
    split) switches novelty from "first seen within the window" to "not seen in training". Times are whole numbers. A peer
    counts from its last event, so an event's peer leaves when the same peer's next event comes or the window passes; a
    gap between events leaves with the earlier of them. ``counters`` adds the sums that a rollback subtracts from. With probes,
    only events within their reach are swept. Where ``events`` are some only, ``baselines`` and ``seen`` (``first_seen``) are those of all.
    """
    parts = sweep_parts(events)
    near = events if probes is None else in_reach(events, probes, window)
    here = sliced(near.select("node", "ts", "incoming", "bytes", "bin", "peer", "eid"), window).repartition(parts, "node", "slice")
    in_time, same_peer = W.partitionBy("node", "slice").orderBy("ts", "eid"), W.partitionBy("node", "slice", "incoming", "peer").orderBy("ts", "eid")
    leaves = F.col("ts") + F.lit(window + 1)
    marked = here.select(
        "*", leaves.alias("leaves"), F.least(F.coalesce(F.lead("ts").over(same_peer), leaves), leaves).alias("peer_leaves"),
        (F.col("ts") - F.lag("ts").over(in_time)).alias("gap"), (F.lead("ts").over(in_time) - F.col("ts")).alias("next_gap"),
    )

    def gap_of(name: str, sign: int) -> list[Column]:
        counted = F.col(name) <= window
        part = lambda v: F.when(counted, v * sign).otherwise(F.lit(0)).cast("long")
        return [part(F.lit(1)).alias("gaps"), part(F.col(name)).alias("gap_sum"), part(F.col(name) * F.col(name)).alias("gap_squares")]

    none = [F.lit(0).cast("long").alias(n) for n in ("gaps", "gap_sum", "gap_squares")]
    zero = F.lit(0)
    steps = F.array(
        F.struct(F.col("ts").alias("t"), F.lit(1).alias("event"), F.lit(1).alias("peers"), *gap_of("gap", 1)),
        F.struct(F.col("leaves").alias("t"), F.lit(-1).alias("event"), zero.alias("peers"), *gap_of("next_gap", -1)),
        F.struct(F.col("peer_leaves").alias("t"), zero.alias("event"), F.lit(-1).alias("peers"), *none),
    )
    moves = marked.select("node", "slice", "core", "incoming", "bin", "bytes", "ts", F.explode(steps).alias("s")).select("node", "slice", "core", "incoming", "bin", "bytes", F.col("s.event").alias("event"), F.col("s.t").alias("t"), "s.peers", "s.gaps", "s.gap_sum", "s.gap_squares")
    if probes is None:
        rows = moves.withColumn("probe", (F.col("event") == 1) & F.col("core"))
    else:
        at = sliced(probes.select("node", "ts").distinct(), window).filter("core")
        blank = {"incoming": F.lit(False), "bin": zero, "bytes": F.lit(0.0), "event": zero, "peers": zero, "gaps": F.lit(0).cast("long"), "gap_sum": F.lit(0).cast("long"), "gap_squares": F.lit(0).cast("long")}
        rows = moves.withColumn("probe", F.lit(False)).unionByName(at.select("node", "slice", "core", F.col("ts").alias("t"), F.lit(True).alias("probe"), *[v.alias(k) for k, v in blank.items()])).repartition(parts, "node", "slice")
    w = W.partitionBy("node", "slice").orderBy("t").rangeBetween(W.unboundedPreceding, 0)
    inc, out = F.col("incoming"), ~F.col("incoming")
    total = lambda test, value: F.coalesce(F.sum(F.when(test, value)).over(w), F.lit(0))
    held = F.coalesce(F.sum("event").over(w), F.lit(0))
    # a sum of bytes that came and went may leave a rounding error; without events it is 0
    volume = lambda test: F.log1p(F.when(total(test, F.col("event")) > 0, F.greatest(total(test, F.col("bytes") * F.col("event")), F.lit(0.0))).otherwise(F.lit(0.0)))
    stated = rows.select(
        "node", "slice", "probe", F.col("t").alias("ts"), F.max(F.when(F.col("event") == 1, F.col("t"))).over(w).alias("last"),
        total(inc, F.col("event")).alias("in_degree"), total(out, F.col("event")).alias("out_degree"), total(out, F.col("peers")).cast("int").alias("unique_dst"), total(inc, F.col("peers")).cast("int").alias("unique_src"),
        F.array(*[total(out & (F.col("bin") == b), F.col("event")) for b in range(N_BINS)]).alias("bins"), volume(inc).alias("in_bytes"), volume(out).alias("out_bytes"),
        held.alias("held"), F.sum("gaps").over(w).alias("gaps"), F.sum("gap_sum").over(w).alias("gap_sum"), F.sum("gap_squares").over(w).alias("gap_squares"),
    ).filter("probe").dropDuplicates(["node", "slice", "ts"])
    mean = F.col("gap_sum") / F.col("gaps")
    spread = F.sqrt(F.greatest(F.col("gap_squares") / F.col("gaps") - mean * mean, F.lit(0.0)))
    stated = stated.withColumn("iat_cv", F.when((F.col("gaps") > 0) & (F.col("gap_sum") > 0), spread / mean).otherwise(F.lit(0.0)))
    joined = stated.join(first_seen(events) if seen is None else seen, "node", "left")
    if trained is None:
        novelty = F.coalesce(F.col("first_seen").between(F.col("ts") - window, F.col("ts")), F.lit(False))
    else:
        joined = joined.join(trained.select("node", F.lit(True).alias("_known")).distinct(), "node", "left")
        novelty = F.coalesce(F.col("first_seen") <= F.col("ts"), F.lit(False)) & F.col("_known").isNull()
    sin, cos = season(F.col("ts"))
    hour = F.floor(F.pmod(F.col("ts") / 3_600_000, F.lit(24.0))).cast("int")
    base = hourly_baselines(events) if baselines is None else baselines
    whole = base.agg(F.max("global_mean").alias("_global"))  # one row
    joined = joined.withColumn("hour", hour).repartition(parts, "node", "hour").join(base, ["node", "hour"], "left").join(F.broadcast(whole), F.lit(True))
    usual = F.coalesce("baseline", "_global")
    return joined.select(
        "node", "ts", (F.lit(0) if internal is None else internal.cast("int")).alias("is_internal"), novelty.cast("int").alias("novelty"),
        F.coalesce(F.least(F.lit(1.0), (F.col("ts") - F.col("last")) / F.lit(float(window))), F.lit(1.0)).alias("recency"),
        "in_degree", "out_degree", "unique_dst", "unique_src", F.size(F.filter("bins", lambda x: x > 0)).alias("unique_bins"),
        entropy(F.transform("bins", lambda x: x.cast("double"))).alias("port_entropy"), "in_bytes", "out_bytes", sin.alias("time_sin"), cos.alias("time_cos"),
        (F.col("in_bytes") + F.col("out_bytes") - usual).alias("volume_deviation"), "iat_cv",
        *([F.struct("bins", "gaps", "gap_sum", "gap_squares", "last").alias("counters")] if counters else []),
    )


def window_sums(events: DataFrame, windows: list[int], probes: DataFrame | None = None) -> DataFrame:
    """node, ts, window, in_degree, out_degree, unique_src, unique_dst, in_bytes, out_bytes at each probe, or each event's node and time. [I9]

    One sorted sweep for all windows: an event arrives once, and leaves each window at its own time, so a sum is what arrived
    less what left that window. Events are sliced by the widest window only. Bytes are plain sums, not logarithms.
    """
    widest = max(windows)
    parts = sweep_parts(events)
    here = sliced(events.select("node", "ts", "incoming", "bytes", "peer", "eid"), widest).repartition(parts, "node", "slice")
    same_peer = W.partitionBy("node", "slice", "incoming", "peer").orderBy("ts", "eid")
    marked = here.withColumn("_next", F.lead("ts").over(same_peer))
    step = lambda t, of, event, peers: F.struct(t.alias("t"), F.lit(of).alias("of"), F.lit(event).alias("event"), F.lit(peers).alias("peers"))
    steps = [step(F.col("ts"), -1, 1, 1)]
    for i, w in enumerate(windows):
        leaves = F.col("ts") + F.lit(w + 1)
        steps += [step(leaves, i, 1, 0), step(F.least(F.coalesce("_next", leaves), leaves), i, 0, 1)]
    moves = marked.select("node", "slice", "core", "incoming", "bytes", F.explode(F.array(*steps)).alias("s")).select("node", "slice", "core", "incoming", "bytes", "s.*")
    if probes is None:
        rows = moves.withColumn("probe", (F.col("of") == -1) & F.col("core"))
    else:
        at = sliced(probes.select("node", "ts").distinct(), widest).filter("core")
        blank = {"incoming": F.lit(False), "bytes": F.lit(0.0), "of": F.lit(-1), "event": F.lit(0), "peers": F.lit(0)}
        marks = at.select("node", "slice", "core", F.col("ts").alias("t"), F.lit(True).alias("probe"), *[v.alias(k) for k, v in blank.items()])
        rows = moves.withColumn("probe", F.lit(False)).unionByName(marks).repartition(parts, "node", "slice")
    upto = W.partitionBy("node", "slice").orderBy("t").rangeBetween(W.unboundedPreceding, 0)
    inc, out = F.col("incoming"), ~F.col("incoming")
    measures = {"in_degree": (inc, F.col("event")), "out_degree": (out, F.col("event")), "unique_src": (inc, F.col("peers")), "unique_dst": (out, F.col("peers")), "in_bytes": (inc, F.col("bytes") * F.col("event")), "out_bytes": (out, F.col("bytes") * F.col("event"))}
    total = lambda name, of: F.coalesce(F.sum(F.when(measures[name][0] & (F.col("of") == of), measures[name][1])).over(upto), F.lit(0))
    swept = rows.select("node", "slice", "probe", F.col("t").alias("ts"), *[total(m, i).alias(f"{m}_{i}") for m in measures for i in range(-1, len(windows))])
    swept = swept.filter("probe").dropDuplicates(["node", "slice", "ts"])

    def held(i: int) -> Column:
        left = {m: F.col(f"{m}_-1") - F.col(f"{m}_{i}") for m in measures}
        for m, degree in (("in_bytes", "in_degree"), ("out_bytes", "out_degree")):  # without events a sum is 0, whatever rounding left
            left[m] = F.when(left[degree] > 0, F.greatest(left[m], F.lit(0.0))).otherwise(F.lit(0.0))
        return F.struct(F.lit(windows[i]).cast("long").alias("window"), *[c.alias(m) for m, c in left.items()])

    return swept.select("node", "ts", F.explode(F.array(*[held(i) for i in range(len(windows))])).alias("_h")).select("node", "ts", "_h.*")


def rolled_back(events: DataFrame, excluded: DataFrame) -> DataFrame:
    """``events`` of each probe without its excluded edges: one record less for each exclusion. [C11]

    ``excluded``: probe, node, ts, incoming, peer. Records and exclusions of equal key are numbered; equal numbers cancel, so
    this is a difference of bags. The result has the column probe; events of nodes without exclusions aren't repeated.
    """
    key = ["node", "ts", "incoming", "peer"]
    mine = excluded.select("probe", "node").distinct().join(events, "node")
    number = lambda df: df.withColumn("_k", F.row_number().over(W.partitionBy("probe", *key).orderBy("probe")))
    return number(mine).join(number(excluded.select("probe", *key)), ["probe", *key, "_k"], "left_anti").drop("_k")


def rolled_back_counts(events: DataFrame, excluded: DataFrame) -> DataFrame:
    """probe, node, records: how many records ``rolled_back`` leaves, from the node's total less what cancels; no event is repeated. [C11]"""
    key = ["node", "ts", "incoming", "peer"]
    gone = excluded.groupBy("probe", *key).agg(F.count("*").alias("_x"))
    there = events.join(excluded.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count("*").alias("_k"))
    less = gone.join(there, key, "left").groupBy("probe", "node").agg(F.sum(F.least("_x", F.coalesce("_k", F.lit(0)))).alias("_less"))
    totals = events.groupBy("node").agg(F.count("*").alias("_n"))
    return less.join(totals, "node").select("probe", "node", (F.col("_n") - F.col("_less")).alias("records")).filter("records > 0")


def snapshots(events: DataFrame, edges: DataFrame, every: int, window: int) -> DataFrame:
    """The state of all nodes seen so far at edges every - 1, 2 * every - 1, ... [E3]"""
    marks = edges.filter(F.pmod(F.col("eid"), F.lit(every)) == every - 1).select("eid", "ts")
    seen = first_seen(events)
    probes = seen.join(F.broadcast(marks), F.col("first_seen") <= F.col("ts")).select("node", "ts", "eid")
    return probes.join(rolling_state(events, window, probes), ["node", "ts"])


def snapshot_degrees(events: DataFrame, edges: DataFrame, every: int, window: int) -> DataFrame:
    """eid, node, in_degree, out_degree of all nodes seen so far at edges every - 1, 2 * every - 1, ... [E3]

    Between two of its changes a node has the same degrees at every mark. Changes are summed by the first mark that they reach,
    so a node has one row for each run of equal marks, and the rows of single marks come last, without a shuffle. Marks, one of
    ``every`` edges, are broadcast.
    """
    marks = written(numbered(edges.filter((F.pmod(F.col("eid"), F.lit(every)) == every - 1) & F.col("ts").isNotNull()).select("eid", "ts"), ["ts", "eid"], name="_mark"), "marks")
    change = lambda t, sign: F.struct(t.alias("at"), F.lit(sign).cast("long").alias("sign"))
    changes = events.filter("ts IS NOT NULL").select("node", "incoming", F.explode(F.array(change(F.col("ts"), 1), change(F.col("ts") + window + 1, -1))).alias("c"))
    placed = counts_upto(marks.select(F.col("ts").alias("_before")), changes.select("node", "incoming", "c.sign", (F.col("c.at") - 1).alias("_before")), [], "_before", "_first")
    side = lambda test: F.sum(F.when(test, F.col("sign")).otherwise(0))
    each = placed.groupBy("node", "_first").agg(side(F.col("incoming")).alias("_in"), side(~F.col("incoming")).alias("_out"))
    in_order = W.partitionBy("node").orderBy("_first")  # a row a mark at most
    upto = in_order.rowsBetween(W.unboundedPreceding, 0)
    runs = each.crossJoin(F.broadcast(marks.agg(F.count("*").alias("_all")))).select(
        "node", "_first", F.sum("_in").over(upto).alias("in_degree"), F.sum("_out").over(upto).alias("out_degree"), F.coalesce(F.lead("_first").over(in_order), F.col("_all")).alias("_next"),
    ).filter(F.col("_first") < F.col("_next"))
    held = lambda c: F.when(F.col("node").isNotNull(), F.col(c)).otherwise(0).alias(c)  # noqa: E731  an unknown node has no events of its own
    shown = runs.select("node", "in_degree", "out_degree", F.explode(F.sequence("_first", F.col("_next") - 1)).alias("_mark"))
    return shown.join(F.broadcast(marks.select("_mark", "eid")), "_mark").select("eid", "node", held("in_degree"), held("out_degree"))


def endpoint_states(edges: DataFrame, events: DataFrame, window: int, dims: list[str]) -> DataFrame:
    """eid and the chosen dimensions of both endpoints at the edge's own time, src_ and dst_ before each name. [C15]"""
    ends = edges.select("eid", F.explode(F.array(F.struct(F.lit("src").alias("end"), F.col("src").alias("node")), F.struct(F.lit("dst").alias("end"), F.col("dst").alias("node")))).alias("e"), "ts").select("eid", "e.end", "e.node", "ts")
    stated = ends.join(rolling_state(events, window, ends).select("node", "ts", *dims), ["node", "ts"])
    pick = lambda end, d: F.max(F.when(F.col("end") == end, F.col(d))).alias(f"{end}_{d}")
    return stated.groupBy("eid").agg(*[pick(end, d) for end in ("src", "dst") for d in dims])
