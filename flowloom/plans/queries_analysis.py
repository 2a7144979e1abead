"""Queries on metrics, statistics, time distributions, attributions, tuning and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions import encode, stats
from flowloom.operators import attribution, balance, checks, fitting, flow_games, graph, metrics, samples, sampling, scoring, shapley, splitting, state, timedist, tuning
from flowloom.plans.queries import EV, NE, TAU, WINDOW, _bad, _split, query, r
from flowloom.plans.scratch import written
from flowloom.sources.flows import events_flow, node_events

GROUPS = ["bytes", "ports", "timing", "flags"]
#: Explanation records, made of the events by arithmetic: what a stored explanation run holds.
REC = f"""{EV}, cl AS (SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT cls AS name FROM ev)),
rec AS (SELECT eid, cls, src, dst, id AS truth, CAST(CASE WHEN eid % 7 = 0 THEN (id + 1) % 5 ELSE id END AS INTEGER) AS predicted,
 [((eid * 7) % 101 - 50) / 50.0, ((eid * 11) % 103 - 51) / 60.0, ((eid * 13) % 107 - 53) / 70.0, CASE WHEN eid % 9 = 0 THEN 0.0 ELSE ((eid * 17) % 109 - 54) / 80.0 END] AS phi,
 ((eid * 31) % 1000) / 1000.0 AS confidence, ((eid * 37) % 200 - 60) / 200.0 AS fidelity_plus, ((eid * 41) % 200 - 100) / 200.0 AS fidelity_minus,
 CASE WHEN eid % 50 = 0 THEN -1.0 ELSE (eid % 90) / 100.0 END AS runtime_s, eid % 8 AS n_neighbours,
 CASE WHEN eid % 3 = 0 THEN 0.0 ELSE (eid % 5) / 10.0 END AS src_phi, CASE WHEN eid % 4 = 0 THEN 0.0 ELSE -(eid % 7) / 10.0 END AS dst_phi FROM ev JOIN cl ON cl.name = ev.cls)"""


def records(spark, sf):
    e = F.col("eid")
    ids = spark.createDataFrame([("click", 0), ("error", 1), ("purchase", 2), ("signup", 3), ("view", 4)], "cls string, truth int")
    ev = events_flow(spark, sf).join(F.broadcast(ids), "cls")
    phi = F.array(
        ((e * 7) % 101 - 50) / 50.0, ((e * 11) % 103 - 51) / 60.0, ((e * 13) % 107 - 53) / 70.0, F.when(e % 9 == 0, 0.0).otherwise(((e * 17) % 109 - 54) / 80.0),
    )
    return ev.select(
        "eid", "cls", "src", "dst", "truth", F.when(e % 7 == 0, (F.col("truth") + 1) % 5).otherwise(F.col("truth")).alias("predicted"), F.array(*[F.lit(g) for g in GROUPS]).alias("groups"), phi.alias("phi"),
        (((e * 31) % 1000) / 1000.0).alias("confidence"), (((e * 37) % 200 - 60) / 200.0).alias("fidelity_plus"), (((e * 41) % 200 - 100) / 200.0).alias("fidelity_minus"),
        F.when(e % 50 == 0, -1.0).otherwise((e % 90) / 100.0).alias("runtime_s"), (e % 8).alias("n_neighbours"),
        F.when(e % 3 == 0, 0.0).otherwise((e % 5) / 10.0).alias("src_phi"), F.when(e % 4 == 0, 0.0).otherwise(-(e % 7) / 10.0).alias("dst_phi"),
    )


# metrics

PER = f"""{REC}, t AS (SELECT truth AS c, count(*) AS support, count(*) FILTER (WHERE truth = predicted) AS hits FROM rec GROUP BY 1), p AS (SELECT predicted AS c, count(*) AS predicted FROM rec GROUP BY 1),
pc AS (SELECT coalesce(t.c, p.c) AS cls, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits FROM t FULL JOIN p ON t.c = p.c),
f1 AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM pc),
sc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM f1)"""


@query(f"WITH {REC} SELECT truth, predicted, count(*) AS n FROM rec GROUP BY ALL")
def d9_confusion(spark, sf):
    return metrics.confusion(records(spark, sf))


@query(f"WITH {PER} SELECT cls, support, predicted, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sc")
def d9_class_metrics(spark, sf):
    m = metrics.per_class(records(spark, sf))
    return m.select("cls", "support", "predicted", "hits", *[r(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {PER} SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM sc")
def d10_summary_union(spark, sf):
    m = metrics.summary(records(spark, sf), "union")
    return m.select(*[r(c).alias(c) for c in m.columns])


@query(f"WITH {PER} SELECT round(avg(f1), 6) AS macro_f1, round(avg(f1) FILTER (WHERE cls >= 2), 6) AS minority_f1, round(0.7 * avg(f1) + 0.3 * avg(f1) FILTER (WHERE cls >= 2), 6) AS composite FROM sc WHERE support > 0")
def d11_minority(spark, sf):
    train = spark.createDataFrame([(0, 5000), (1, 900)], "cls int, n_train long")
    m = metrics.minority_summary(records(spark, sf), train, 500, 0.3)
    return m.select(*[r(c).alias(c) for c in m.columns])


@query(f"WITH {PER} SELECT round(sum(f1) / 8, 6) AS macro_full, round(avg(f1), 6) AS macro_supported, round(avg(f1) FILTER (WHERE cls IN (0, 1, 4)), 6) AS macro_closed FROM sc WHERE support > 0")
def d28_denominators(spark, sf):
    closed = spark.createDataFrame([(0,), (1,), (4,)], "cls int")
    m = metrics.denominators(metrics.per_class(records(spark, sf)), closed, 8)
    return m.select(*[r(c).alias(c) for c in m.columns])


@query(f"""WITH {EV}, s AS (SELECT c.cls, (eid * 31) % 1000 AS score, ev.cls = c.cls AS positive FROM ev, (SELECT DISTINCT cls FROM ev) c),
k AS (SELECT *, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0 AS rk FROM s)
SELECT cls, count(*) FILTER (WHERE positive) AS positives, round((sum(rk) FILTER (WHERE positive) - count(*) FILTER (WHERE positive) * (count(*) FILTER (WHERE positive) + 1) / 2.0) / (count(*) FILTER (WHERE positive) * count(*) FILTER (WHERE NOT positive)), 6) AS auc FROM k GROUP BY cls""")
def d12_roc_auc(spark, sf):
    ev = events_flow(spark, sf)
    names = F.array(*[F.lit(c) for c in ("click", "error", "purchase", "signup", "view")])
    rows = ev.select(F.explode(names).alias("c"), ((F.col("eid") * 31) % 1000).alias("score"), "cls").select(F.col("c").alias("cls"), "score", (F.col("cls") == F.col("c")).alias("positive"))
    return metrics.roc_auc(rows).select("cls", "positives", r("auc").alias("auc"))


# statistics


@query(f"""WITH {EV}, u AS (SELECT src AS k, cls, round(avg(in_bytes), 6) AS x, count(*) AS y FROM ev GROUP BY ALL), p AS (SELECT a.cls, sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM u a JOIN u b ON a.cls = b.cls AND a.k < b.k)
SELECT cls, round(sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))), 6) AS tau FROM p GROUP BY cls""")
def h21_kendall(spark, sf):
    u = events_flow(spark, sf).groupBy("src", "cls").agg(r(F.avg("in_bytes")).alias("x"), F.count("*").alias("y"))
    return stats.kendall(u, "x", "y", ["cls"], "src").select("cls", r("tau").alias("tau"))


@query(f"""WITH {EV}, p AS (SELECT eid % 5 AS fam, eid, CASE WHEN eid % 13 = 0 THEN NULL ELSE ((eid * 7919) % 10007) / 10007.0 END AS p FROM ev),
k AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, eid) AS rk, count(*) OVER (PARTITION BY fam) AS n FROM p WHERE p IS NOT NULL),
q AS (SELECT fam, eid, least(1.0, min(p * n / rk) OVER (PARTITION BY fam ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k) SELECT p.fam, p.eid, round(q, 6) AS q FROM p LEFT JOIN q ON q.fam = p.fam AND q.eid = p.eid""")
def e13_false_discovery(spark, sf):
    e = F.col("eid")
    rows = events_flow(spark, sf).select((e % 5).alias("fam"), "eid", F.when(e % 13 != 0, ((e * 7919) % 10007) / 10007.0).alias("p"))
    return stats.false_discovery(rows, "p", ["fam"], "eid").select("fam", "eid", r("q").alias("q"))


@query(f"""WITH {EV}, d AS (SELECT cls, in_bytes - (eid % 90) AS d FROM ev), z AS (SELECT cls, d, abs(d) AS a FROM d WHERE d <> 0), k AS (SELECT *, rank() OVER (PARTITION BY cls ORDER BY a) + (count(*) OVER (PARTITION BY cls, a) - 1) / 2.0 AS rk FROM z)
SELECT cls, count(*) AS n, round(least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)), 2) AS w FROM k GROUP BY cls""")
def h22_wilcoxon(spark, sf):
    rows = events_flow(spark, sf).select("cls", F.col("in_bytes").alias("x"), (F.col("eid") % 90).cast("double").alias("y"))
    return stats.wilcoxon(rows, "x", "y", ["cls"]).select("cls", "n", r("w", 2).alias("w"))


@query(f"""WITH {EV}, m AS (SELECT src, cls, round(avg(in_bytes), 6) AS v FROM ev GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY src ORDER BY v) + (count(*) OVER (PARTITION BY src, v) - 1) / 2.0 AS rk FROM m),
t AS (SELECT cls, sum(rk) AS s, count(*) AS n FROM k GROUP BY cls), g AS (SELECT count(*) AS k, max(n) AS n, sum(s * s) AS ss FROM t), q AS (SELECT sum(rk * rk) AS sq FROM k)
SELECT n AS blocks, k AS treatments, round((k - 1) * (ss / n - n * k * (k + 1) * (k + 1) / 4.0) / (sq - n * k * (k + 1) * (k + 1) / 4.0), 4) AS statistic FROM g, q""")
def h22_friedman(spark, sf):
    m = events_flow(spark, sf).groupBy("src", "cls").agg(r(F.avg("in_bytes")).alias("v"))
    return stats.friedman(m, "v", "src", "cls").select("blocks", "treatments", r("statistic", 4).alias("statistic"))


@query(f"""WITH {EV}, s AS (SELECT src, list(DISTINCT dst) FILTER (WHERE cls = 'view') AS a, list(DISTINCT dst) FILTER (WHERE cls = 'click') AS b FROM ev GROUP BY src)
SELECT src, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS overlap FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
def g5_set_overlap(spark, sf):
    s = events_flow(spark, sf).groupBy("src").agg(F.collect_set(F.when(F.col("cls") == "view", F.col("dst"))).alias("a"), F.collect_set(F.when(F.col("cls") == "click", F.col("dst"))).alias("b"))
    return s.filter("size(a) > 0 AND size(b) > 0").select("src", r(stats.set_overlap(F.col("a"), F.col("b"))).alias("overlap"))


# time distributions

HIST = f"{EV}, t0 AS (SELECT min(ts) AS t0 FROM ev), h AS (SELECT cls, CAST(floor((ts - t0) / 3600000.0) AS BIGINT) AS bin, count(*) AS n FROM ev, t0 GROUP BY ALL)"
CDF = f"{HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY cls ORDER BY bin) / sum(n) OVER (PARTITION BY cls) AS cdf FROM h)"


@query(f"WITH {HIST} SELECT * FROM h")
def i2_class_histogram(spark, sf):
    return timedist.histogram(events_flow(spark, sf))


@query(f"WITH {CDF} SELECT cls, bin, n, round(cdf, 6) AS cdf FROM c")
def e9_cumulative(spark, sf):
    return timedist.cumulative(timedist.histogram(events_flow(spark, sf))).select("cls", "bin", "n", r("cdf").alias("cdf"))


@query(f"WITH {CDF} SELECT cls, min(bin) FILTER (WHERE cdf >= 0.1) AS q10, min(bin) FILTER (WHERE cdf >= 0.5) AS q50, min(bin) FILTER (WHERE cdf >= 0.9) AS q90, min(bin) FILTER (WHERE cdf >= 0.5) - min(bin) FILTER (WHERE cdf >= 0.1) <= 0.2 * (min(bin) FILTER (WHERE cdf >= 0.9) - min(bin) FILTER (WHERE cdf >= 0.5)) AND min(bin) FILTER (WHERE cdf >= 0.5) <= 180 AS burst FROM c GROUP BY cls")
def i4_bursts(spark, sf):
    return timedist.bursts(timedist.histogram(events_flow(spark, sf)), 720)


@query(f"WITH {HIST} SELECT cls, coalesce(CAST(sum(n) FILTER (WHERE abs(bin + 0.5 - 300) <= 24) AS BIGINT), 0) AS n FROM h GROUP BY cls")
def e10_windowed_sum(spark, sf):
    return timedist.windowed_sum(timedist.histogram(events_flow(spark, sf)), 300, 24)


@query(f"WITH {HIST} SELECT cls, arg_min(bin, (-n, bin)) AS peak_bin, max(n) AS peak, median(n) AS median FROM h GROUP BY cls")
def i3_hourly_peaks(spark, sf):
    return timedist.hourly_peaks(timedist.histogram(events_flow(spark, sf)))


@query(f"WITH {EV}, {TAU}, s AS (SELECT max(ts) - min(ts) AS span FROM ev), x AS (SELECT cls, count(*) AS n, count(*) FILTER (WHERE abs(ts - a) <= span * 0.01) AS near FROM ev, tau, s GROUP BY cls) SELECT cls, n, near, round(near / (n * 2 * 0.01), 6) AS density, near / (n * 2 * 0.01) >= 5 AS dense FROM x")
def i5_boundary_density(spark, sf):
    ev = events_flow(spark, sf)
    return timedist.boundary_density(ev, splitting.thresholds(ev, 0.6, 0.3)).select("cls", "n", "near", r("density").alias("density"), "dense")


@query(f"WITH {EV}, {TAU}, c AS (SELECT cls, s.split, count(sp.eid) AS n FROM (SELECT DISTINCT e.cls, v.split FROM ev e, (VALUES ('train'), ('val'), ('test')) v(split)) s LEFT JOIN sp USING (cls, split) GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY cls) AS whole FROM c) SELECT cls, split, n FROM w WHERE n < 30 OR n < whole * 0.01")
def i6_thin_classes(spark, sf):
    return timedist.thin_classes(splitting.coverage(_split(spark, sf)))


@query(f"""WITH {EV}, z AS (SELECT cls, min(ts) AS a, max(ts) AS b FROM ev GROUP BY cls), w AS (SELECT ev.cls, least(floor((ts - a) * 5.0 / greatest(b - a, 1)), 4) AS w, avg(in_bytes) AS m FROM ev JOIN z ON z.cls = ev.cls GROUP BY ALL)
SELECT cls, count(*) AS windows, round(stddev_pop(m), 6) AS spread FROM w GROUP BY cls""")
def e14_window_spread(spark, sf):
    return timedist.window_means(events_flow(spark, sf), "in_bytes", 5).select("cls", "windows", r("spread").alias("spread"))


@query(f"WITH {EV}, k AS (SELECT cls, in_bytes, row_number() OVER (PARTITION BY cls ORDER BY eid) AS rk, count(*) OVER (PARTITION BY cls) AS n FROM ev) SELECT cls, round(avg(in_bytes) FILTER (WHERE rk <= floor(n / 2)), 6) AS first_mean, round(avg(in_bytes) FILTER (WHERE rk > floor(n / 2)), 6) AS rest_mean FROM k GROUP BY cls")
def e15_halves(spark, sf):
    return timedist.halves(events_flow(spark, sf), "in_bytes").select("cls", r("first_mean").alias("first_mean"), r("rest_mean").alias("rest_mean"))


@query(f"""WITH {EV}, g AS (SELECT ts - lag(ts) OVER (ORDER BY ts) AS gap, lag(ts) OVER (ORDER BY ts) AS s, ts AS e FROM ev), m AS (SELECT * FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, s LIMIT 1), x AS (SELECT min(ts) AS t0, max(ts) - min(ts) AS span FROM ev)
SELECT gap, s AS gap_start, e AS gap_end, CASE WHEN gap >= 0.05 * span THEN CAST(e AS DOUBLE) ELSE t0 + 0.9 * span END AS zoom_start FROM m, x""")
def e8_largest_gap(spark, sf):
    return timedist.largest_gap(events_flow(spark, sf))


# attributions

LONG = f"{REC}, lf AS (SELECT eid, cls, unnest(['bytes', 'ports', 'timing', 'flags']) AS grp, unnest(phi) AS phi, unnest([0, 1, 2, 3]) AS place FROM rec), pf AS (SELECT cls, grp, avg(abs(phi)) AS mean_abs FROM lf GROUP BY ALL), pr AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY mean_abs DESC, grp) AS place FROM pf)"


@query(f"WITH {LONG} SELECT cls, grp, round(mean_abs, 6) AS mean_abs, place FROM pr")
def d27_class_profiles(spark, sf):
    return attribution.class_profiles(records(spark, sf)).select("cls", "grp", r("mean_abs").alias("mean_abs"), "place")


@query(f"WITH {LONG}, c AS (SELECT *, sum(mean_abs) OVER (PARTITION BY cls) AS t, sum(mean_abs) OVER (PARTITION BY cls ORDER BY place) AS u FROM pr) SELECT cls, coalesce(min(place) FILTER (WHERE t > 0 AND u >= t * 0.8 - 1e-12), count(*)) AS n FROM c GROUP BY cls")
def e11_concentration(spark, sf):
    return attribution.concentration(attribution.class_profiles(records(spark, sf)))


@query(f"WITH {LONG}, f AS (SELECT cls, grp FROM lf QUALIFY row_number() OVER (PARTITION BY eid ORDER BY abs(phi) DESC, place) = 1), c AS (SELECT cls, grp, count(*) AS times FROM f GROUP BY ALL) SELECT cls, grp AS top1, times FROM c QUALIFY row_number() OVER (PARTITION BY cls ORDER BY times DESC, grp) = 1")
def m28_top_group(spark, sf):
    return attribution.top_group(records(spark, sf))


@query(f"WITH {LONG}, m AS (SELECT cls, grp, avg(phi) AS mean_phi FROM lf GROUP BY ALL) SELECT cls, grp, round(mean_phi, 6) AS mean_phi FROM m QUALIFY row_number() OVER (PARTITION BY cls ORDER BY mean_phi, grp) = 1")
def m29_most_negative(spark, sf):
    return attribution.most_negative(records(spark, sf)).select("cls", "grp", r("mean_phi").alias("mean_phi"))


@query(f"WITH {LONG}, s AS (SELECT cls, eid % 300 AS f, grp, stddev_pop(phi) AS s FROM lf GROUP BY ALL), w AS (SELECT cls, f, avg(s) AS m, max(s) AS x FROM s GROUP BY ALL) SELECT cls, round(avg(m), 6) AS mean_std, round(max(x), 6) AS max_std FROM w GROUP BY cls")
def d16_stability(spark, sf):
    runs = attribution.long_form(records(spark, sf)).withColumn("eid", F.col("eid") % 300)
    return attribution.stability(runs).select("cls", r("mean_std").alias("mean_std"), r("max_std").alias("max_std"))


@query(f"""WITH {REC} SELECT cls, count(*) AS n, round(avg(fidelity_plus), 4) AS mean_plus, round(stddev_pop(fidelity_plus), 4) AS std_plus, round(avg(fidelity_minus), 4) AS mean_minus, round(stddev_pop(fidelity_minus), 4) AS std_minus, round(avg(runtime_s) FILTER (WHERE runtime_s >= 0), 4) AS mean_runtime FROM rec GROUP BY ROLLUP (cls)""")
def d13_fidelity_summary(spark, sf):
    return attribution.fidelity_summary(records(spark, sf))


@query(f"""WITH {REC} SELECT cls, round(avg(n_neighbours), 6) AS mean_n, count(*) FILTER (WHERE n_neighbours >= 1) AS n_nonempty, round(avg(fidelity_plus) FILTER (WHERE n_neighbours >= 1), 6) AS plus_nonempty, count(*) FILTER (WHERE n_neighbours > 3) AS n_informative, round(avg(fidelity_minus) FILTER (WHERE n_neighbours > 3), 6) AS minus_informative FROM rec GROUP BY ROLLUP (cls)""")
def d14_temporal_summary(spark, sf):
    s = attribution.temporal_summary(records(spark, sf))
    return s.select("cls", r("mean_n").alias("mean_n"), "n_nonempty", r("plus_nonempty").alias("plus_nonempty"), "n_informative", r("minus_informative").alias("minus_informative"))


@query(f"""WITH {REC}, e AS (SELECT cls, abs(list_sum(phi) - (list_sum(phi) + ((eid % 5) / 100.0 + 0.00037))) AS err, list_sum(phi) + ((eid % 5) / 100.0 + 0.00037) AS gap FROM rec)
SELECT cls, round(avg(err), 6) AS mean_err, round(max(err), 6) AS max_err, round(avg(CASE WHEN err <= greatest(0.1 * abs(gap), 0.001) THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM e GROUP BY ROLLUP (cls)""")
def d20_efficiency_audit(spark, sf):
    total = F.aggregate("phi", F.lit(0.0), lambda a, x: a + x)
    rows = records(spark, sf).withColumn("base", F.lit(0.25)).withColumn("value", F.col("base") + total + ((F.col("eid") % 5) / 100.0 + 0.00037))
    s = attribution.efficiency_audit(rows)
    return s.select("cls", r("mean_err").alias("mean_err"), r("max_err").alias("max_err"), r("pass_rate").alias("pass_rate"))


@query(f"""WITH {REC} SELECT cls, count(*) AS n, count(*) FILTER (WHERE abs(src_phi) > 1e-6 OR abs(dst_phi) > 1e-6) AS any_unseen, count(*) FILTER (WHERE abs(src_phi) > 1e-6 AND abs(dst_phi) > 1e-6) AS both_unseen, round(avg(CASE WHEN abs(src_phi) > 1e-6 OR abs(dst_phi) > 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS any_fraction FROM rec GROUP BY ROLLUP (cls)""")
def d24_endpoint_firing(spark, sf):
    return attribution.firing_table(records(spark, sf)).withColumn("any_fraction", r("any_fraction"))


@query("WITH s AS (SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'private' ELSE 'public' END AS kind FROM nation) SELECT kind, count(*) AS n, string_agg(name, '|' ORDER BY name) AS names FROM s GROUP BY kind")
def d22_node_table(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "private").otherwise("public").alias("kind"))
    return attribution.node_table(n).withColumn("names", F.concat_ws("|", "names"))


@query(f"""WITH {EV}, p AS (SELECT cls, src, dst, count(*) AS n FROM ev GROUP BY ALL), s AS (SELECT cls, avg(k) AS dst_per_src FROM (SELECT cls, src, count(*) AS k FROM p GROUP BY ALL) GROUP BY cls), d AS (SELECT cls, avg(k) AS src_per_dst FROM (SELECT cls, dst, count(*) AS k FROM p GROUP BY ALL) GROUP BY cls), m AS (SELECT cls, max(n) / sum(n) AS modal_share FROM p GROUP BY cls)
SELECT cls, round(dst_per_src, 6) AS dst_per_src, round(src_per_dst, 6) AS src_per_dst, round(modal_share, 6) AS modal_share, CASE WHEN dst_per_src >= 3 AND dst_per_src > src_per_dst THEN 'fan_out' WHEN src_per_dst >= 3 AND src_per_dst > dst_per_src THEN 'fan_in' WHEN modal_share >= 0.5 THEN 'persistent' ELSE 'other' END AS kind FROM s JOIN d USING (cls) JOIN m USING (cls)""")
def d25_topology(spark, sf):
    t = attribution.topology(events_flow(spark, sf))
    return t.select("cls", *[r(c).alias(c) for c in ("dst_per_src", "src_per_dst", "modal_share")], "kind")


@query(f"""WITH {REC}, s AS (SELECT cls, abs(phi[1]) + abs(phi[2]) AS f, abs(phi[3]) AS t, abs(phi[4]) AS n FROM rec) SELECT cls, round(avg(f / CASE WHEN f + t + n > 0 THEN f + t + n ELSE 1 END), 6) AS phi_f_share, round(avg(t / CASE WHEN f + t + n > 0 THEN f + t + n ELSE 1 END), 6) AS phi_t_share, round(avg(n / CASE WHEN f + t + n > 0 THEN f + t + n ELSE 1 END), 6) AS phi_n_share FROM s GROUP BY cls""")
def d30_decomposition(spark, sf):
    rows = records(spark, sf).select("cls", F.slice("phi", 1, 2).alias("phi_f"), F.slice("phi", 3, 1).alias("phi_t"), F.slice("phi", 4, 1).alias("phi_n"))
    d = attribution.decomposition(rows, ["phi_f", "phi_t", "phi_n"])
    return d.select("cls", *[r(c).alias(c) for c in d.columns[1:]])


@query(f"WITH {REC}, b AS (SELECT fidelity_plus > 0 AS present, truth = predicted AS correct, fidelity_plus AS f FROM rec) SELECT present, correct, count(*) AS n, round(median(f), 6) AS median, round(stddev_pop(f), 6) AS spread FROM b GROUP BY CUBE (present, correct)")
def d33_presence_breakdown(spark, sf):
    b = attribution.presence_breakdown(records(spark, sf))
    return b.select("present", "correct", "n", r("median").alias("median"), r("spread").alias("spread"))


@query(f"WITH {REC} SELECT cls, count(*) AS n, round(avg(CASE WHEN fidelity_plus <= 0 THEN 1.0 ELSE 0 END), 6) AS fraction, round(stddev_samp(CASE WHEN fidelity_plus <= 0 THEN 1.0 ELSE 0 END) / sqrt(count(*)), 6) AS sem FROM rec GROUP BY cls")
def d34_absence(spark, sf):
    return attribution.absence(records(spark, sf)).select("cls", "n", r("fraction").alias("fraction"), r("sem").alias("sem"))


@query(f"WITH {LONG} SELECT cls, " + ", ".join(f"round(sum(mean_abs) FILTER (WHERE grp = '{g}') / sum(mean_abs), 6) AS {g}" for g in GROUPS) + " FROM pf GROUP BY cls")
def d31_affinity(spark, sf):
    a = attribution.affinity(attribution.class_profiles(records(spark, sf)), GROUPS)
    return a.select("cls", *[r(g).alias(g) for g in GROUPS])


@query(f"""WITH {REC}, x AS (SELECT *, abs(src_phi) + abs(dst_phi) AS magnitude FROM rec WHERE cls <> 'error' OR truth <> predicted), b AS (SELECT cls, eid, 'curated' AS how FROM x WHERE truth = predicted AND magnitude > 1e-6 QUALIFY row_number() OVER (PARTITION BY cls ORDER BY confidence DESC, magnitude DESC, eid) = 1)
SELECT * FROM b UNION ALL (SELECT cls, eid, 'fallback' FROM x WHERE cls NOT IN (SELECT cls FROM b) QUALIFY row_number() OVER (PARTITION BY cls ORDER BY confidence DESC, eid) = 1)""")
def f8_case_candidates(spark, sf):
    rows = records(spark, sf).filter("cls <> 'error' OR truth <> predicted").withColumn("magnitude", F.abs("src_phi") + F.abs("dst_phi"))
    return attribution.curated(rows)


@query(f"WITH {REC}, p AS (SELECT cls, eid % 40 + 2 - eid % 2 - eid % 3 AS p FROM rec) SELECT cls, count(*) AS flows, round(avg(p), 6) AS mean_players, count(*) FILTER (WHERE p <= 1 OR (p <= 30 AND pow(2, p) - 2 <= 2048)) AS exhaustive FROM p GROUP BY cls")
def d36_exactness(spark, sf):
    rows = records(spark, sf).select("cls", (F.col("eid") % 40).alias("n_nodes"), (F.col("eid") % 2).alias("n_degenerate"), (F.col("eid") % 3).alias("n_dummy"))
    return attribution.exactness(rows, 2048).withColumn("mean_players", r("mean_players"))


@query(f"WITH {REC}, e AS (SELECT eid // 50 AS seed_eid, src, dst, phi[1] AS phi FROM rec) SELECT seed_eid, node, round(sum(abs(phi)), 6) AS score FROM (SELECT seed_eid, src AS node, phi FROM e UNION ALL SELECT seed_eid, dst, phi FROM e) GROUP BY ALL")
def h17_edge_to_node(spark, sf):
    rows = records(spark, sf).select(F.expr("eid div 50").alias("seed_eid"), "src", "dst", F.col("phi")[0].alias("phi"))
    return attribution.edge_to_node_scores(rows).withColumn("score", r("score"))


@query(f"WITH {REC} SELECT eid, 'a' AS grp, round(abs(phi[1]) + abs(phi[3]), 6) AS importance FROM rec UNION ALL SELECT eid, 'b', round(abs(phi[2]) + abs(phi[4]), 6) FROM rec")
def h16_group_importance(spark, sf):
    groups = spark.createDataFrame([(0, "a"), (2, "a"), (1, "b"), (3, "b")], "idx int, grp string")
    return attribution.group_importance(records(spark, sf).select("eid", F.col("phi").alias("scores")), F.broadcast(groups)).withColumn("importance", r("importance"))


@query(f"WITH {PER} SELECT cls, unnest(['precision', 'recall', 'f1']) AS metric, round(unnest([precision, recall, f1]), 6) AS value FROM sc")
def m18_long_metrics(spark, sf):
    m = metrics.per_class(records(spark, sf))
    return attribution.long_metrics(m.select("cls", "precision", "recall", "f1"), ["cls"], ["precision", "recall", "f1"]).withColumn("value", r("value"))


@query(f"WITH {PER} SELECT cls, round(f1, 6) AS value, 0.85::DOUBLE AS other, round(f1 - 0.85, 6) AS delta, f1 > 0.85 AS improved FROM sc")
def c19_comparison(spark, sf):
    m = metrics.per_class(records(spark, sf)).select("cls", F.col("f1").alias("value"))
    c = attribution.improvement(m, m.select("cls", F.lit(0.85).alias("other")))
    return c.select("cls", r("value").alias("value"), "other", r("delta").alias("delta"), "improved")


# scoring and Shapley values


@query("SELECT label, i - 1 AS pos, round(avg(v), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def d2_class_backgrounds(spark, sf):
    return scoring.class_backgrounds(spark.read.parquet(f"{sf}/embeddings.parquet"), "embedding", "label").select("label", "pos", r("mean", 5).alias("mean"))


SAGE = f"""{EV}, no AS (SELECT node, count(*) * 1.0 AS a, avg(b) AS b FROM (SELECT src AS node, in_bytes AS b FROM ev UNION ALL SELECT dst, in_bytes FROM ev) GROUP BY node),
ag AS (SELECT ev.dst AS node, avg(no.a) AS ma, avg(no.b) AS mb FROM ev JOIN no ON no.node = ev.src GROUP BY 1), hi AS (SELECT no.node, greatest(0, 0.5 * a - 0.2 * b + 0.1 * coalesce(ma, 0) + 0.3 * coalesce(mb, 0)) AS h0, greatest(0, -0.1 * a + 0.4 * b + 0.2 * coalesce(ma, 0) - 0.1 * coalesce(mb, 0)) AS h1 FROM no LEFT JOIN ag USING (node))"""


@query(f"WITH {SAGE} SELECT eid, round(0.3 * s.h0 - 0.2 * s.h1 + 0.1 * d.h0 + 0.4 * d.h1 - 1, 4) AS logit FROM ev JOIN hi s ON s.node = src JOIN hi d ON d.node = dst")
def j13_sage_logits(spark, sf):
    ev = events_flow(spark, sf)
    nodes = ev.select(F.explode(F.array("src", "dst")).alias("node"), "in_bytes").groupBy("node").agg(F.count("*").cast("double").alias("a"), F.avg("in_bytes").alias("b"))
    hidden = scoring.sage_layer(ev, nodes, ["a", "b"], [[0.5, -0.2], [-0.1, 0.4]], [[0.1, 0.3], [0.2, -0.1]])
    return scoring.edge_logits(ev, hidden, 2, [0.3, -0.2, 0.1, 0.4], -1.0).select("eid", r("logit", 4).alias("logit"))


def _games(spark, sf):
    e = F.col("eid")
    x = F.array(F.col("in_bytes") / 100, (F.col("port") / 65536.0), (e % 10) / 10.0, F.when(e % 3 == 0, 0.5).otherwise((e % 7) / 7.0))
    return events_flow(spark, sf).select("eid", "cls", x.alias("x"), F.array(F.lit(0.3), F.lit(0.5), F.lit(0.4), F.lit(0.5)).alias("background"))


#: Exact Shapley values of four players by enumeration: the gain of each player over each coalition of the others.
K1_SQL = f"""WITH {EV}, g AS (SELECT eid, [in_bytes / 100 + 10, port / 65536.0 + 10, CASE WHEN eid % 10 <> 4 THEN (eid % 10) / 10.0 + 10 ELSE 0.4 END, CASE WHEN eid % 3 <> 0 THEN (eid % 7) / 7.0 + 10 ELSE 0.5 END] AS x FROM ev),
m AS (SELECT CAST(i AS INTEGER) AS m, [i & 1, (i // 2) & 1, (i // 4) & 1, (i // 8) & 1] AS z FROM range(16) t(i)),
v AS (SELECT eid, m, z, tanh(-0.1 + 0.08 * (CASE WHEN z[1] = 1 THEN x[1] ELSE 0.3 END) - 0.05 * (CASE WHEN z[2] = 1 THEN x[2] ELSE 0.5 END) + 0.03 * (CASE WHEN z[3] = 1 THEN x[3] ELSE 0.4 END) + 0.02 * (CASE WHEN z[4] = 1 THEN x[4] ELSE 0.5 END)) AS v FROM g, m),
w AS (SELECT v.eid, p.i, [6, 2, 2, 6][1 + CAST(list_sum(v.z) AS INTEGER)] / 24.0 * (u.v - v.v) AS gain FROM v JOIN (SELECT unnest(range(4)) AS i) p ON v.z[p.i + 1] = 0 JOIN v u ON u.eid = v.eid AND u.m = v.m + CAST(pow(2, p.i) AS INTEGER)),
f AS (SELECT eid, i, sum(gain) AS phi FROM w GROUP BY ALL)
SELECT eid, CAST(CASE WHEN eid % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN eid % 10 = 4 THEN 1 ELSE 0 END AS INTEGER) AS degenerate, round(sum(phi) FILTER (WHERE i = 0), 5) AS phi0, round(sum(phi) FILTER (WHERE i = 1), 5) AS phi1, abs(round(sum(phi) FILTER (WHERE i = 2), 5)) AS phi2, abs(round(sum(phi) FILTER (WHERE i = 3), 5)) AS phi3 FROM f GROUP BY eid"""


@query(K1_SQL)
def k1_feature_attribution(spark, sf):
    games = _games(spark, sf).withColumn("x", F.transform("x", lambda v, i: F.when(i == 0, v + 10).when(i == 1, v + 10).when((i == 2) & (F.col("eid") % 10 != 4), v + 10).when((i == 3) & (F.col("eid") % 3 != 0), v + 10).otherwise(F.element_at("background", i + 1))))
    out = shapley.feature_attribution(games, [[0], [1], [2], [3]], [0.08, -0.05, 0.03, 0.02], -0.1)
    return out.select("eid", "degenerate", r(F.col("phi")[0], 5).alias("phi0"), r(F.col("phi")[1], 5).alias("phi1"), F.abs(r(F.col("phi")[2], 5)).alias("phi2"), F.abs(r(F.col("phi")[3], 5)).alias("phi3"))


@query()
def k7_linear_fidelity(spark, sf):
    games = _games(spark, sf)
    phi = F.zip_with(F.zip_with("x", "background", lambda a, b: a - b), F.array(F.lit(0.8), F.lit(-0.5), F.lit(0.3), F.lit(0.2)), lambda d, w: d * w)
    return shapley.linear_fidelity(games.withColumn("phi", phi), 2, [0.8, -0.5, 0.3, 0.2], -0.1)


CLASSES = ["click", "error", "purchase", "signup", "view"]
FANOUTS = [2, 3]
#: Flows of each class that the scorer is fitted on and judged by, at most: a bounded sample of the earlier splits.
FIT_ROWS, JUDGE_ROWS = 200, 100


def _labelled(spark, flows):
    ids = spark.createDataFrame([(c, i) for i, c in enumerate(CLASSES)], "cls string, label int")
    return flows.join(F.broadcast(ids), "cls")


def _split_sample(spark, ev):
    """Seeds that the scorer is fitted on or judged by (part), and the class weights of the training split."""
    split = splitting.with_split(ev, splitting.thresholds(ev, 0.6, 0.3))
    parts = [samples.bottom_k(split.filter(F.col("split") == part), n, ["cls"], "eid", seed=1).withColumn("part", F.lit(part)) for part, n in (("train", FIT_ROWS), ("val", JUDGE_ROWS))]
    seeds = written(_labelled(spark, parts[0].unionByName(parts[1])).select("eid", "ts", "src", "dst", "label", "part"), "fit-seeds")
    weights = balance.class_weights(_labelled(spark, split.filter("split = 'train'")), "label", len(CLASSES)).orderBy("label").collect()  # a row a class
    return seeds, [w["weight"] for w in weights]


def _fitted_on(context, seeds, weights):
    return fitting.fit(fitting.packed(context.join(seeds.select(F.col("eid").alias("seed_eid"), "part"), "seed_eid")), len(CLASSES), weights)


def _fitted(spark, sf, ev=None, near=None):
    """The scorer, fitted on flows of the training split, stopped by those of the validation split; ``near`` may hold their samples, among others."""
    ev = written(events_flow(spark, sf), "flows") if ev is None else ev
    seeds, weights = _split_sample(spark, ev)
    mine = None if near is None else written(near.join(F.broadcast(seeds.select(F.col("eid").alias("seed_eid")).distinct()), "seed_eid", "left_semi"), "sample")
    return _fitted_on(flow_games.flow_context(ev, node_events(ev), seeds, FANOUTS, WINDOW, mine), seeds, weights)


_ASKED = "eid % 100 = 0"


def _context(spark, sf):
    """Flows whose id is divisible by 100, with their two-hop samples from all edges."""
    ev = written(events_flow(spark, sf), "flows")
    seeds = _labelled(spark, ev.filter(_ASKED)).select("eid", "ts", "src", "dst", "label")
    events = node_events(ev)
    return written(flow_games.flow_context(ev, events, seeds, FANOUTS, WINDOW), "context"), events


def _context_and_fitted(spark, sf):
    """``_context`` and the scorer of ``_fitted``: the flows of both are sampled, and all events swept, once."""
    ev = written(events_flow(spark, sf), "flows")
    fit, weights = _split_sample(spark, ev)
    asked = _labelled(spark, ev.filter(_ASKED)).select("eid", "ts", "src", "dst", "label")
    events = node_events(ev)
    others = fit.filter(~F.coalesce(F.expr(_ASKED), F.lit(False))).drop("part")
    context = written(flow_games.flow_context(ev, events, asked.unionByName(others), FANOUTS, WINDOW), "context")
    return context.filter(_ASKED.replace("eid", "seed_eid")), events, _fitted_on(context, fit, weights)


@query()
def j14_fit_history(spark, sf):
    return spark.createDataFrame(_fitted(spark, sf).history, "epoch int, train_loss double, val_macro_f1 double, best boolean")


@query()
def k3_neighbour_attribution(spark, sf):
    context, events, fitted = _context_and_fitted(spark, sf)
    return flow_games.neighbour_games(context, flow_games.rollback_records(context, events, WINDOW), fitted.scorer, WINDOW)


@query()
def d14_neighbour_fidelity(spark, sf):
    """The temporal summary of what the games on neighbour edges return."""
    played = k3_neighbour_attribution(spark, sf).withColumn("n_neighbours", F.size("players"))
    named = played.join(events_flow(spark, sf).select(F.col("eid").alias("seed_eid"), "cls"), "seed_eid")
    out = attribution.temporal_summary(named)
    return out.select("cls", "n_nonempty", "n_informative", *[r(c).alias(c) for c in ("mean_n", "plus_nonempty", "minus_informative")])


@query()
def d15_novelty_summary(spark, sf):
    """Novelty among the strongest players of the games on nodes."""
    played = k4_node_attribution(spark, sf).withColumn("n_players", F.size("nodes") + 2 - F.col("n_degenerate") - F.col("n_dummy"))
    named = played.join(events_flow(spark, sf).select(F.col("eid").alias("seed_eid"), "cls"), "seed_eid")
    out = attribution.novelty_summary(named)
    return out.select("cls", "n", "with_novelty", "n_informative", "with_novelty_informative", *[r(c).alias(c) for c in ("share", "share_informative", "mean_plus", "mean_minus")])


@query()
def k4_node_attribution(spark, sf):
    context, _, fitted = _context_and_fitted(spark, sf)
    return flow_games.node_games(context, flow_games.label_backgrounds(context), fitted.scorer)


@query(f"""WITH {EV}, {NE}, s AS (SELECT eid AS seed_eid, ts AS t, unnest([src, dst]) AS node FROM ev WHERE eid % 100 = 0)
SELECT s.seed_eid, s.node, count(*) FILTER (WHERE inc) AS in_degree, count(*) FILTER (WHERE NOT inc) AS out_degree FROM (SELECT DISTINCT * FROM s) s JOIN ne ON ne.node = s.node AND ne.ts BETWEEN s.t - {WINDOW} AND s.t GROUP BY ALL""")
def m10_flow_context(spark, sf):
    context, _ = _context(spark, sf)
    ends = context.select("seed_eid", F.explode(F.filter("nodes", lambda n: (n["node"] == F.col("seed_src")) | (n["node"] == F.col("seed_dst")))).alias("n"))
    degree = lambda d: F.element_at("n.x", flow_games.DIMS.index(d) + 1).cast("long").alias(d)
    return ends.select("seed_eid", "n.node", degree("in_degree"), degree("out_degree"))


@query()
def f13_connected_subgraph(spark, sf):
    ev = events_flow(spark, sf)
    seeds = ev
    near = sampling.sampled_neighbours(ev, seeds, [5, 5])
    ends = seeds.select(F.col("eid").alias("seed_eid"), F.col("src").alias("seed_src"), F.col("dst").alias("seed_dst"))
    rows = near.join(ends, "seed_eid").withColumn("phi", ((F.col("eid") * 31) % 101 - 50) / 50.0)
    return shapley.connected_top_k(rows.select("seed_eid", "eid", "src", "dst", "phi", "seed_src", "seed_dst"), 5)


# tuning and checks

AXES = {"hidden": [64, 128, 256], "dropout": [0.1, 0.3], "layers": [1, 2]}
TRIALS = "t AS (SELECT (h.i * 2 + d.i) * 2 + l.i AS trial, [64, 128, 256][h.i + 1] AS hidden, CAST([0.1, 0.3][d.i + 1] AS DOUBLE) AS dropout, [1, 2][l.i + 1] AS layers FROM range(3) h(i), range(2) d(i), range(2) l(i)), s AS (SELECT *, 0.8 + ((trial * 7) % 5) / 1000.0 AS score FROM t)"


@query(f"WITH {TRIALS} SELECT trial, hidden, dropout, layers FROM t")
def j16_grid(spark, sf):
    return tuning.grid(spark, AXES)


@query(f"WITH {TRIALS}, m AS (SELECT max(score) AS m FROM s) SELECT trial FROM s, m WHERE m - score <= 0.002 + 1e-12 ORDER BY hidden, dropout, layers, trial LIMIT 1")
def f14_tie_aware_best(spark, sf):
    scored = tuning.grid(spark, AXES).withColumn("score", 0.8 + ((F.col("trial") * 7) % 5) / 1000.0)
    return tuning.select_best_in_band(scored, 0.2 + 1e-10, AXES).select("trial")


@query(f"WITH {TRIALS}, d AS (SELECT trial FROM t WHERE trial % 5 <> 0 UNION ALL SELECT 3 UNION ALL SELECT 77) SELECT trial, 'missing' AS fault FROM t WHERE trial NOT IN (SELECT trial FROM d) UNION ALL SELECT DISTINCT trial, 'foreign' FROM d WHERE trial NOT IN (SELECT trial FROM t) UNION ALL SELECT trial, 'duplicate' FROM d GROUP BY trial HAVING count(*) > 1")
def g6_merge_faults(spark, sf):
    trials = tuning.grid(spark, AXES)
    done = trials.filter("trial % 5 <> 0").select("trial").union(spark.range(3, 4)).union(spark.range(77, 78))
    return tuning.merge_faults(done, trials)


@query(f"""WITH {EV}, {TAU}, t AS (SELECT max(ts) FILTER (WHERE split='train') AS tb, min(ts) FILTER (WHERE split='val') AS va, max(ts) FILTER (WHERE split='val') AS vb, min(ts) FILTER (WHERE split='test') AS sa, count(DISTINCT eid) AS d FROM sp)
SELECT 'splits' AS section, 'disjoint' AS name, 'PASS' AS status, CAST(d AS VARCHAR) AS message FROM t UNION ALL SELECT 'splits', 'train before val', CASE WHEN tb < va THEN 'PASS' ELSE 'FAIL' END, CAST(va - tb AS VARCHAR) FROM t UNION ALL SELECT 'splits', 'val before test', CASE WHEN vb < sa THEN 'PASS' ELSE 'FAIL' END, CAST(sa - vb AS VARCHAR) FROM t""")
def m2_split_checks(spark, sf):
    return checks.split_checks(_split(spark, sf))


@query(f"""WITH {EV}, {TAU}, l AS (SELECT split, ln(1 + greatest(in_bytes, 0.0)) AS x FROM sp), f AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM l WHERE split = 'train'), z AS (SELECT abs(round(avg((x - m) / s), 4)) AS m, round(stddev_pop((x - m) / s), 4) AS s FROM l, f WHERE split = 'train')
SELECT 'scaling' AS section, unnest(['train mean', 'train deviation']) AS name, unnest([CASE WHEN m < 0.001 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN abs(s - 1) < 0.001 THEN 'PASS' ELSE 'FAIL' END]) AS status, unnest([CAST(m AS VARCHAR), CAST(s AS VARCHAR)]) AS message FROM z""")
def m7_scaling_checks(spark, sf):
    rows = _split(spark, sf).withColumn("x", encode.log_scale(F.col("in_bytes")))
    return checks.scaling_checks(encode.scale_with(rows, encode.fit_scaler(rows.filter("split = 'train'"), ["x"]), ["x"]), "x")


@query(f"WITH {EV} SELECT 'encoding' AS section, 'ports sum to one' AS name, CASE WHEN count(*) FILTER (WHERE bin IS NULL OR bin NOT BETWEEN 0 AND 15) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(count(*) FILTER (WHERE bin IS NULL OR bin NOT BETWEEN 0 AND 15) AS VARCHAR) AS message FROM ev")
def m4_port_checks(spark, sf):
    return checks.one_hot_checks(events_flow(spark, sf).select(encode.one_hot(encode.port_bin(F.col("port")), 16).alias("bins")))


@query("SELECT 'balance' AS section, unnest(['within train', 'keeps originals']) AS name, 'PASS' AS status, '0' AS message")
def m6_balance_checks(spark, sf):
    ev = events_flow(spark, sf)
    return checks.balance_checks(ev.select("eid"), balance.oversample(ev, "cls", 0.7))
