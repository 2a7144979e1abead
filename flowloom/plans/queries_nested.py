"""Queries on JSON of unknown shape, the topologies of classes compared, and games that fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import failures, graph, nested, shapley
from flowloom.plans.queries import EV, ROLES, _bad, query, r
from flowloom.plans.queries_analysis import K1_SQL, _games
from flowloom.sources.flows import events_flow

KINDS = "CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"


@query(f"""WITH t AS (SELECT event_type AS cls, fullkey AS path, {KINDS} AS kind, atom FROM events, json_tree(events.props))
SELECT cls, path, kind, count(*) AS n, min(CASE WHEN kind = 'number' THEN CAST(atom AS DOUBLE) END) AS lo, max(CASE WHEN kind = 'number' THEN CAST(atom AS DOUBLE) END) AS hi FROM t GROUP BY ALL""")
def m21_event_paths(spark, sf):
    paths = nested.json_paths(spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("event_type", "cls"), "props", ["cls"])
    return paths.groupBy("cls", "path", "kind").agg(F.count("*").alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi"))


#: Orders with their lines as JSON; of every 97th the last brace is gone.
@query(f"""WITH lines AS (SELECT l_orderkey AS o_orderkey, list({{'part': l_partkey, 'sum': l_extendedprice, 'flags': [l_returnflag, l_linestatus], 'whole': l_discount = 0}} ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey, o_orderstatus AS cls, json_object('id', o_orderkey, 'at', json_object('total', o_totalprice, 'note', NULL, 'by', o_orderpriority), 'lines', lines) AS j FROM orders JOIN lines USING (o_orderkey)),
t AS (SELECT cls, regexp_replace(fullkey, '\\[[0-9]+\\]', '[*]', 'g') AS path, {KINDS} AS kind, atom FROM (SELECT * FROM d WHERE o_orderkey % 97 <> 0) d, json_tree(d.j)
 UNION ALL SELECT cls, '$', 'malformed', NULL FROM d WHERE o_orderkey % 97 = 0)
SELECT cls, path, kind, count(*) AS n, round(sum(CASE WHEN kind = 'number' THEN CAST(atom AS DOUBLE) END), 2) AS total, count(DISTINCT CASE WHEN kind = 'string' THEN CAST(atom AS VARCHAR) END) AS texts FROM t GROUP BY ALL""")
def m21_order_paths(spark, sf):
    line = F.struct(F.col("l_linenumber").alias("_at"), F.struct(F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("sum"), F.array("l_returnflag", "l_linestatus").alias("flags"), (F.col("l_discount") == 0).alias("whole")).alias("line"))
    # dealt out before they become JSON of many times their size, which a plan that goes by bytes would give to few tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_discount")
    lines = items.repartition(tasks, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    at = F.struct(F.col("o_totalprice").alias("total"), F.lit(None).cast("string").alias("note"), F.col("o_orderpriority").alias("by"))
    whole = F.to_json(F.struct(F.col("o_orderkey").alias("id"), at.alias("at"), "lines"), {"ignoreNullFields": "false"})
    docs = spark.read.parquet(f"{sf}/orders.parquet").join(lines, "o_orderkey").select(F.col("o_orderstatus").alias("cls"), F.when(F.col("o_orderkey") % 97 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("doc"))
    # raw paths and texts are few: they are counted as they are, then places are blotted out
    text = F.when(F.col("kind") == "string", F.col("text")).alias("text")
    each = nested.json_paths(docs, "doc", ["cls"]).groupBy("cls", "path", "kind", text).agg(F.count("*").alias("n"), F.sum("number").alias("total"))
    return each.withColumn("path", F.regexp_replace("path", r"\[[0-9]+\]", "[*]")).groupBy("cls", "path", "kind").agg(F.sum("n").alias("n"), r(F.sum("total"), 2).alias("total"), F.countDistinct("text").alias("texts"))


#: Expectations that a user gives, by class.
EXPECTED = {"click": "other", "error": "fan_out"}


@query(f"""WITH {ROLES}, p AS (SELECT cls, src, dst, count(*) AS n FROM mal GROUP BY ALL), s AS (SELECT cls, avg(k) AS a FROM (SELECT cls, src, count(*) AS k FROM p GROUP BY ALL) GROUP BY cls), d AS (SELECT cls, avg(k) AS b FROM (SELECT cls, dst, count(*) AS k FROM p GROUP BY ALL) GROUP BY cls), m AS (SELECT cls, max(n) / sum(n) AS modal, sum(n)::BIGINT AS n_edges FROM p GROUP BY cls),
ours AS (SELECT cls, n_edges, CASE WHEN a >= 3 AND a > b THEN 'fan_out' WHEN b >= 3 AND b > a THEN 'fan_in' WHEN modal >= 0.5 THEN 'persistent' ELSE 'other' END AS ours FROM s JOIN d USING (cls) JOIN m USING (cls)),
c AS (SELECT cls, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM mal GROUP BY cls), u AS (SELECT count(DISTINCT (n_src, n_dst)) <= 1 AND count(*) > 1 AS same FROM c),
me AS (SELECT cls, n_src, n_dst, CASE WHEN same THEN 'indeterminate_identical' WHEN n_src >= 3 * n_dst THEN 'fan_in' WHEN n_dst >= 3 * n_src THEN 'fan_out' WHEN n_src = 1 AND n_dst = 1 THEN 'persistent' ELSE 'other' END AS measured FROM c, u),
z AS (SELECT x.cls, avg(d) FILTER (WHERE is_internal) AS mean_d FROM (SELECT DISTINCT cls, dst AS node FROM mal) x JOIN ro USING (node) LEFT JOIN bfs USING (node) GROUP BY 1),
w AS (SELECT *, CASE cls WHEN 'click' THEN 'other' WHEN 'error' THEN 'fan_out' ELSE 'not_supplied' END AS literature FROM ours JOIN me USING (cls) JOIN z USING (cls))
SELECT cls, ours, literature, measured, CASE WHEN literature = 'not_supplied' THEN 'literature_missing' WHEN ours = measured AND ours = literature THEN 'full' WHEN ours = measured THEN 'ours_measured' WHEN ours = literature THEN 'ours_literature' WHEN measured = literature THEN 'measured_literature' ELSE 'none' END AS agreement,
 n_edges, CAST(n_src AS DOUBLE) AS n_src, CAST(n_dst AS DOUBLE) AS n_dst, round(mean_d, 6) AS mean_d, CAST(NULL AS DOUBLE) AS diameter FROM w""")
def m21_structural_coherence(spark, sf):
    """The measurements go through one JSON artifact, a few values a class, and are read back from it without its schema."""
    bad, ro = _bad(spark, sf)
    counts = bad.groupBy("cls").agg(F.countDistinct("src").alias("n_src_nodes"), F.countDistinct("dst").alias("n_dst_nodes"))
    measured = counts.join(graph.distance_stats(bad, graph.gateway_distances(bad, ro), ro).select("cls", F.col("mean_d").alias("mean")), "cls")
    by_class = lambda *c: F.struct(F.map_from_entries(F.collect_list(F.struct("cls", F.struct(*c)))).alias("per_class"))  # noqa: E731  a row a class
    whole = F.struct(by_class("mean", "n_src_nodes", "n_dst_nodes").alias("d_gw"), by_class(F.lit(None).cast("double").alias("diameter")).alias("diameter"))
    paths = nested.json_paths(measured.agg(F.to_json(whole, {"ignoreNullFields": "false"}).alias("doc")), "doc", [])
    stage = nested.per_class(paths, ["d_gw", "per_class"], {"n_src_nodes": "n_src", "n_dst_nodes": "n_dst", "mean": "mean_d"}).join(nested.per_class(paths, ["diameter", "per_class"], {"diameter": "diameter"}), "cls", "left")
    out = nested.structural_coherence(bad, stage, spark.createDataFrame(list(EXPECTED.items()), "cls string, literature string"))
    return out.withColumn("mean_d", r("mean_d"))


_POISON = "CASE WHEN eid % 13 = 5 THEN 'x missing' WHEN eid % 17 = 3 THEN 'x has 3 values, not 4' WHEN eid % 19 = 4 THEN CASE WHEN eid % 2 = 0 THEN 'x {1} not finite' ELSE 'x {0,3} not finite' END WHEN eid % 23 = 6 THEN 'background {2} not finite' END"


@query(f"""WITH k AS ({K1_SQL}), e AS (SELECT eid, {_POISON} AS error FROM (SELECT event_id AS eid FROM events))
SELECT eid, error, CASE WHEN error IS NULL THEN degenerate END AS degenerate, CASE WHEN error IS NULL THEN phi0 END AS phi0, CASE WHEN error IS NULL THEN phi1 END AS phi1 FROM e JOIN k USING (eid)""")
def k6_failed_games(spark, sf):
    """The games of all events, of which some hold nulls, NaN, infinities or too few features: those are rows with their fault, all others are scored."""
    e = F.col("eid")
    up = F.transform("x", lambda v, i: F.when(i == 0, v + 10).when(i == 1, v + 10).when((i == 2) & (e % 10 != 4), v + 10).when((i == 3) & (e % 3 != 0), v + 10).otherwise(F.element_at("background", i + 1)))
    holes = F.transform("x", lambda v, i: F.when((e % 2 == 0) & (i == 1), float("nan")).when((e % 2 == 1) & (i == 0), float("inf")).when((e % 2 == 1) & (i == 3), F.lit(None)).otherwise(v))
    games = _games(spark, sf).withColumn("x", up).withColumn("x", F.when(e % 13 == 5, F.lit(None)).when(e % 17 == 3, F.slice("x", 1, 3)).when(e % 19 == 4, holes).otherwise(F.col("x")))
    games = games.withColumn("background", F.when(e % 23 == 6, F.transform("background", lambda v, i: F.when(i == 2, float("-inf")).otherwise(v))).otherwise(F.col("background")))
    out = shapley.feature_attribution(games, [[0], [1], [2], [3]], [0.08, -0.05, 0.03, 0.02], -0.1, errors=True)
    return out.select("eid", "error", "degenerate", r(F.col("phi")[0], 5).alias("phi0"), r(F.col("phi")[1], 5).alias("phi1"))


@query(f"""WITH {EV}, d AS (SELECT cls, eid, {_POISON} AS error FROM ev) SELECT cls, error, count(*) AS n FROM d GROUP BY ALL""")
def k6_outcomes(spark, sf):
    """How many games of each class ended how."""
    return failures.outcomes(k6_failed_games(spark, sf).join(events_flow(spark, sf).select("eid", "cls"), "eid"), ["cls"])
