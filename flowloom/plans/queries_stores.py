"""Queries on the feature store, irregular time bins, runs of numbers, the trial ledger and states of several windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions import encode
from flowloom.operators import ablation, ledger, ranges, sampling, splitting, state, timedist
from flowloom.plans.queries import EV, NE, TAU, query, r
from flowloom.plans.queries_analysis import FANOUTS, _fitted, _labelled
from flowloom.plans.scratch import new_path, written
from flowloom.sources import feature_store as store
from flowloom.sources.flows import events_flow, node_events, orders_flow

#: Windows that are compared, in seconds.
WINDOWS = [1800, 3600, 21600]


def _orders_store(spark, sf):
    path = new_path(spark, "store")
    store.write_store(orders_flow(spark, sf).select("eid", "ts", "src", "in_bytes", "cls"), path)
    return path


@query("SELECT l_orderkey AS eid, l_linenumber, epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000 AS ts, o_custkey AS src, o_totalprice AS in_bytes, o_orderstatus AS cls FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def c3_feature_store(spark, sf):
    asks = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("eid"), "l_linenumber")
    return store.features(spark, _orders_store(spark, sf), asks)


@query("SELECT DISTINCT event_id * 3 - 30 AS eid FROM events WHERE event_id * 3 - 30 NOT IN (SELECT o_orderkey FROM orders)")
def c3_absent_keys(spark, sf):
    return store.absent(spark, _orders_store(spark, sf), events_flow(spark, sf).select((F.col("eid") * 3 - 30).alias("eid")))


@query("SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, true AS rising FROM orders")
def a4_store_manifest(spark, sf):
    files = store.open_store(spark, _orders_store(spark, sf))
    apart = ranges.scan(files.filter("n > 0"), {"upto": ("max", F.col("hi"))}, ["lo"]).filter(F.col("upto") > F.col("hi"))  # a range that another holds
    return files.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(F.broadcast(apart.agg((F.count("*") == 0).alias("rising"))), F.lit(True))


ZOOM = """g AS (SELECT ts - lag(ts) OVER (ORDER BY ts) AS gap, lag(ts) OVER (ORDER BY ts) AS s, ts AS e FROM ev), m AS (SELECT * FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, s LIMIT 1),
x AS (SELECT min(ts) AS t0, max(ts) - min(ts) AS span FROM ev), z AS (SELECT CASE WHEN gap >= 0.05 * span THEN CAST(e AS DOUBLE) ELSE t0 + CAST(0.9 AS DOUBLE) * span END AS zoom, t0, greatest(1, CAST(ceil(span / 3600000.0) AS BIGINT)) AS hours FROM m, x)"""
#: Bins of a minute, at most this many: the cap binds on the events' span, so an hour has fewer than 60 bins.
MOST_BINS = 20_000


@query(f"""WITH {EV}, {TAU}, {ZOOM}, h AS (SELECT z.*, CASE WHEN hours * 60 > {MOST_BINS} THEN greatest(1, {MOST_BINS} // hours) ELSE 60 END AS per FROM z),
even AS (SELECT i / CAST(per AS DOUBLE) AS edge FROM h, range(0, (SELECT hours * per + 1 FROM h)) t(i)),
more AS (SELECT (zoom - t0) / CAST(3600000 AS DOUBLE) AS edge FROM h UNION SELECT (a - t0) / CAST(3600000 AS DOUBLE) FROM h, tau),
edges AS (SELECT edge FROM even UNION SELECT edge FROM more, h WHERE edge > 0 AND edge < hours AND abs(round(edge * per) / per - edge) > 0.5e-6 / per),
bins AS (SELECT row_number() OVER (ORDER BY edge) - 1 AS bin, edge AS start_h, lead(edge) OVER (ORDER BY edge) AS end_h FROM edges),
e AS (SELECT cls, (ts - t0) / CAST(3600000 AS DOUBLE) AS e FROM ev, h)
SELECT cls, bin, round(start_h, 9) AS start_h, round(end_h, 9) AS end_h, count(*) AS n FROM e ASOF JOIN (FROM bins WHERE end_h IS NOT NULL) b ON e.e >= b.start_h GROUP BY ALL""")
def i2_fine_histogram(spark, sf):
    """Bins with the start of the zoomed region and the training cut as edges: rows tied at the cut start a bin."""
    ev = events_flow(spark, sf)
    cut = splitting.thresholds(ev, 0.6, 0.3).select("tau_train").join(F.broadcast(timedist.largest_gap(ev).select("zoom_start")), F.lit(True))  # one row each
    t0 = timedist.span(ev).select("t0")
    extra = cut.join(F.broadcast(t0), F.lit(True)).select(F.array(*[(F.col(c) - F.col("t0")) / timedist.HOUR for c in ("zoom_start", "tau_train")]).alias("extra_h"))
    return timedist.fine_histogram(ev, timedist.fine_grid(ev, extra, 60, MOST_BINS)).select("cls", "bin", r("start_h", 9).alias("start_h"), r("end_h", 9).alias("end_h"), "n")


@query(f"WITH {EV}, {TAU} SELECT cls, count(*) AS n, count(*) FILTER (WHERE ts <= a) AS n_train, count(*) FILTER (WHERE ts > a AND ts <= b) AS n_val, count(*) FILTER (WHERE ts > b) AS n_test, count(*) FILTER (WHERE ts = a) AS tie_train, count(*) FILTER (WHERE ts = b) AS tie_val FROM ev, tau GROUP BY cls")
def i2_split_support(spark, sf):
    ev = events_flow(spark, sf)
    return timedist.split_support(ev, splitting.thresholds(ev, 0.6, 0.3))


@query("""WITH v AS (SELECT event_id AS a, lead(event_id) OVER (ORDER BY event_id) AS b FROM (SELECT event_id FROM events WHERE event_type = 'view' UNION SELECT min(event_id) - 1 FROM events UNION SELECT max(event_id) + 1 FROM events))
SELECT a + 1 AS first, b - 1 AS last, b - a - 1 AS n FROM v WHERE b > a + 1""")
def g6_id_gaps(spark, sf):
    """Runs of event ids that no view has."""
    ev = events_flow(spark, sf)
    ends = ev.agg(F.min("eid").alias("a"), F.max("eid").alias("b")).first()
    return ranges.gaps(ev.filter("cls = 'view'"), "eid", ends["a"], ends["b"])


RULES = {"least": [5.0, 20.0, 50.0, 100.0, 200.0], "before": [6, 12, 18, 24], "kind": ["purchase", "click"]}
CHEAP = {"before": "last", "least": "first"}


@query(f"""WITH {EV}, t AS (SELECT (l.i * 4 + h.i) * 2 + k.i AS trial, CAST([5.0, 20.0, 50.0, 100.0, 200.0][l.i + 1] AS DOUBLE) AS least, [6, 12, 18, 24][h.i + 1] AS before, ['purchase', 'click'][k.i + 1] AS kind FROM range(5) l(i), range(4) h(i), range(2) k(i)),
p AS (SELECT t.*, ev.cls = kind AS truth, in_bytes >= least AND (ts // 3600000) % 24 < before AS said FROM t, ev),
s AS (SELECT trial, least, before, kind, round(2.0 * count(*) FILTER (WHERE truth AND said) / greatest(2 * count(*) FILTER (WHERE truth AND said) + count(*) FILTER (WHERE truth <> said), 1), 6) AS score FROM p GROUP BY ALL),
m AS (SELECT max(score) AS m FROM s), b AS (SELECT trial FROM s, m WHERE m - score <= CAST(0.5 AS DOUBLE) / 100 ORDER BY before DESC, least, trial LIMIT 1)
SELECT s.trial, least, before, kind, score, s.trial = (SELECT trial FROM s ORDER BY score DESC, trial LIMIT 1) AS argmax, m - score <= CAST(0.5 AS DOUBLE) / 100 AS in_band, s.trial = b.trial AS winner FROM s, m, b""")
def j15_trial_ledger(spark, sf):
    """A grid of rules on the events, scored by F1: stopped after two batches, resumed, promoted."""
    ev = events_flow(spark, sf)

    def evaluate(trials):
        truth = F.col("cls") == F.col("kind")
        said = (F.col("in_bytes") >= F.col("least")) & (F.floor(F.col("ts") / 3_600_000) % 24 < F.col("before"))
        each = ev.join(F.broadcast(trials), F.lit(True))  # a batch of trials; events are counted, not kept
        hits, wrong = F.count_if(truth & said), F.count_if(truth != said)
        return each.groupBy("trial").agg(r(2 * hits / F.greatest(2 * hits + wrong, F.lit(1))).alias("score"))

    path, config = new_path(spark, "ledger"), {"seed": 0, "score": "f1"}
    ledger.run(spark, path, RULES, config, evaluate, batch=10, batches=2)
    ledger.run(spark, path, RULES, config, evaluate, batch=10)
    return ledger.promote(spark, path, RULES, config, 0.5, CHEAP)


def _swept(w):
    over = f"OVER (PARTITION BY node ORDER BY ts RANGE BETWEEN {w * 1000} PRECEDING AND CURRENT ROW)"
    count, peers = f"count(*) FILTER (WHERE {{}}inc) {over}", f"count(DISTINCT peer) FILTER (WHERE {{}}inc) {over}"
    total = f"round(coalesce(sum(bytes) FILTER (WHERE {{}}inc) {over}, 0), 4)"
    measures = [("in_degree", count, ""), ("out_degree", count, "NOT "), ("unique_src", peers, ""), ("unique_dst", peers, "NOT "), ("in_bytes", total, ""), ("out_bytes", total, "NOT ")]
    return f"SELECT DISTINCT node, ts, CAST({w * 1000} AS BIGINT) AS \"window\", " + ", ".join(f"{sql.format(side)} AS {name}" for name, sql, side in measures) + " FROM ne"


@query(f"WITH {EV}, {NE} " + " UNION ALL ".join(_swept(w) for w in WINDOWS))
def i9_window_sums(spark, sf):
    """All events' nodes and times, three windows in one sweep."""
    out = state.window_sums(node_events(events_flow(spark, sf)), [w * 1000 for w in WINDOWS])
    return out.withColumns({c: r(c, 4) for c in ("in_bytes", "out_bytes")})


@query()
def m31_window_curve(spark, sf):
    """Coverage and attribution under each window: all flows are sampled, the fitted scorer plays the first five covered ones of each class."""
    ev = written(events_flow(spark, sf), "flows")
    seeds = _labelled(spark, ev).select("eid", "ts", "src", "dst", "label", "cls")
    near = written(sampling.sampled_neighbours(ev, seeds, FANOUTS), "sample")
    gaps, games = ablation.window_games(ev, node_events(ev), seeds, FANOUTS, _fitted(spark, sf, ev, near).scorer, WINDOWS, near=near)
    curve = ablation.window_curve(sampling.window_coverage(gaps, seeds, WINDOWS), written(games, "games"))
    return curve.select("w", "n_games", *[r(c).alias(c) for c in ("coverage", "p5", "median", "p95", "mean_top", "max_top", "delta")])


@query("""WITH c AS (SELECT l_returnflag, count(*) AS n, sum(count(*)) OVER () AS whole FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice, CASE WHEN n >= whole * CAST(0.3 AS DOUBLE) THEN l_returnflag END AS flag FROM lineitem JOIN c USING (l_returnflag)""")
def m5_inverse_encoders(spark, sf):
    """Scaled and encoded line items turned back; rare flags share an index, so they can't be."""
    rows, scaled = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("l_extendedprice"), "l_returnflag"), ["l_quantity", "l_extendedprice"]
    found, names = encode.fit_scaler(rows, scaled), encode.fit_categories(rows, "l_returnflag", 0.3)
    coded = encode.encode_categories(encode.scale_with(rows, found, scaled), names, "l_returnflag").drop("l_returnflag")
    back = encode.decode_categories(encode.unscale_with(coded, found, scaled), names, "l_returnflag", "flag")
    return back.select("l_orderkey", "l_linenumber", *[r(c, 4).alias(c) for c in scaled], "flag")
