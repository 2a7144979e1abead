"""Queries on comparisons, report tables and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions import encode, stats
from flowloom.operators import attribution, reports
from flowloom.operators.ordering import with_eid
from flowloom.plans.queries import EV, TAU, _split, query, r
from flowloom.plans.queries_analysis import REC, records
from flowloom.sources.flows import events_flow


@query(f"WITH {REC} SELECT cls, count(*) AS n, round(avg(confidence), 6) AS confidence FROM rec WHERE truth = predicted GROUP BY cls")
def b11_correct_records(spark, sf):
    return reports.correct(records(spark, sf)).groupBy("cls").agg(F.count("*").alias("n"), r(F.avg("confidence")).alias("confidence"))


@query(f"WITH {REC} SELECT ev.eid, ev.src, coalesce(s.phi, 0.0) AS phi FROM ev LEFT JOIN (SELECT eid, src_phi AS phi FROM rec WHERE eid % 3 = 1) s ON s.eid = ev.eid")
def c14_default_scores(spark, sf):
    scores = records(spark, sf).filter("eid % 3 = 1").select("eid", F.col("src_phi").alias("phi"))
    return reports.with_default_score(events_flow(spark, sf).select("eid", "src"), scores)


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
 CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders)
SELECT a.o_orderkey, 'o_custkey' AS "column", CAST(a.o_custkey AS VARCHAR) AS "left", CAST(b.o_custkey AS VARCHAR) AS "right" FROM a JOIN b USING (o_orderkey) WHERE a.o_custkey IS DISTINCT FROM b.o_custkey
UNION ALL SELECT a.o_orderkey, 'o_orderstatus', a.o_orderstatus, b.o_orderstatus FROM a JOIN b USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def c20_mismatches(spark, sf):
    a = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    b = a.select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("o_custkey"), F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return reports.mismatches(a, b, "o_orderkey", ["o_custkey", "o_orderstatus"])


@query(f"""WITH {REC}, m AS (SELECT concat('m', eid % 3) AS method, * FROM rec)
SELECT method, cls, count(*) AS n, round(avg(fidelity_plus), 6) AS plus, round(avg(fidelity_minus), 6) AS minus FROM m GROUP BY GROUPING SETS ((method, cls), (method))""")
def d19_method_table(spark, sf):
    rows = records(spark, sf).withColumn("method", F.concat(F.lit("m"), (F.col("eid") % 3).cast("string")))
    return reports.method_table(rows).select("method", "cls", "n", r("plus").alias("plus"), r("minus").alias("minus"))


@query(f"""WITH {EV}, c AS (SELECT cls, count(DISTINCT CASE WHEN cls = 'click' THEN src % 2 ELSE src END) AS n_src, count(DISTINCT CASE WHEN cls = 'error' THEN 1 ELSE dst END) AS n_dst FROM ev GROUP BY cls)
SELECT cls, CASE WHEN n_src >= 3 * n_dst THEN 'fan_in' WHEN n_dst >= 3 * n_src THEN 'fan_out' WHEN n_src = 1 AND n_dst = 1 THEN 'persistent' ELSE 'other' END AS topology FROM c""")
def d26_stage_topology(spark, sf):
    src, dst = F.when(F.col("cls") == "click", F.col("src") % 2).otherwise(F.col("src")), F.when(F.col("cls") == "error", 1).otherwise(F.col("dst"))
    return reports.stage_topology(events_flow(spark, sf).groupBy("cls").agg(F.countDistinct(src).alias("n_src"), F.countDistinct(dst).alias("n_dst")))


@query(f"WITH {REC}, a AS (SELECT eid, list_transform(phi, lambda x: abs(x)) AS s FROM rec) SELECT eid, round(list_max(s), 6) AS top_phi, round(list_max(s) - list_min(s), 6) AS phi_range FROM a")
def d38_case_quality(spark, sf):
    return reports.case_quality(records(spark, sf)).select("eid", r("top_phi").alias("top_phi"), r("phi_range").alias("phi_range"))


@query(f"WITH {EV}, p AS (SELECT cls, row_number() OVER (ORDER BY ts, eid) - 1 AS pos FROM ev) SELECT cls, count(*) AS n, min(pos) AS first_at, max(pos) AS last_at, CAST(sum(pos) AS BIGINT) AS places FROM p GROUP BY cls")
def e16_class_positions(spark, sf):
    rows = with_eid(events_flow(spark, sf).withColumnRenamed("eid", "id"), "ts", ("id",))
    return rows.groupBy("cls").agg(F.count("*").alias("n"), F.min("eid").alias("first_at"), F.max("eid").alias("last_at"), F.sum("eid").alias("places"))


@query(f"""WITH {EV}, {TAU}, o AS (SELECT split, row_number() OVER (ORDER BY ts, eid) - 1 AS id FROM sp)
SELECT split, count(*) AS n, min(id) AS "first", max(id) AS "last", max(id) - min(id) + 1 = count(*) AS gapless, true AS follows FROM o GROUP BY split""")
def g8_split_continuity(spark, sf):
    rows = with_eid(_split(spark, sf).withColumnRenamed("eid", "id"), "ts", ("id",))
    return reports.split_continuity(rows, ["train", "val", "test"])


COLUMNS = ["l_quantity", "l_extendedprice", "doubled", "l_discount", "l_tax", "inverse"]


def _priced(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * 2).alias("doubled"), "l_discount", "l_tax", (-F.col("l_quantity")).alias("inverse"))


RANKED = "WITH l AS (SELECT *, l_extendedprice * 2 AS doubled, -l_quantity AS inverse FROM lineitem), k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in COLUMNS) + " FROM l)"


@query(RANKED + " ".join("" if (i, j) == (0, 0) else f"{' UNION ALL' if (i, j) != (0, 1) else ''} SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS rho FROM k" for i, x in enumerate(COLUMNS) for j, y in enumerate(COLUMNS) if i < j))
def h5_rank_correlations(spark, sf):
    return reports.rank_correlations(_priced(spark, sf), COLUMNS).select("x", "y", r("rho").alias("rho"))


@query("SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS name")
def h5_pruned_columns(spark, sf):
    stay = reports.pruned_columns(reports.rank_correlations(_priced(spark, sf), COLUMNS), COLUMNS)
    return spark.createDataFrame([(c,) for c in stay], "name string")


IPS = "concat([10, 172, 192, 8][CAST(o_orderkey % 4 AS INTEGER) + 1], '.', o_orderkey % 40, '.', o_orderkey % 7, '.', o_orderkey % 250)"


@query(f"SELECT o_orderkey, {IPS} AS ip, o_orderkey % 4 = 0 OR (o_orderkey % 4 = 1 AND o_orderkey % 40 BETWEEN 16 AND 31) AS inside FROM orders")
def h8_address_prefixes(spark, sf):
    k = F.col("o_orderkey")
    first = F.element_at(F.array(*[F.lit(x) for x in ("10", "172", "192", "8")]), (k % 4 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.concat_ws(".", first, *[(k % n).cast("string") for n in (40, 7, 250)]).alias("ip"))
    return rows.select("o_orderkey", "ip", encode.in_any_prefix(F.col("ip"), ["10.0.0.0/8", "172.16.0.0/12"]).alias("inside"))


@query(f"""WITH {REC}, e AS (SELECT eid, phi, list_transform(phi, lambda x: exp(x)) AS x FROM rec)
SELECT eid, round(x[1] / list_sum(x), 6) AS p0, round(x[4] / list_sum(x), 6) AS p3, CAST(list_position(phi, list_max(phi)) - 1 AS INTEGER) AS best FROM e""")
def h15_softmax(spark, sf):
    p = encode.softmax(F.col("phi"))
    return records(spark, sf).select("eid", r(p[0]).alias("p0"), r(p[3]).alias("p3"), encode.argmax(F.col("phi")).cast("int").alias("best"))


@query(f"""WITH {REC}, l AS (SELECT eid, unnest(phi) AS v, generate_subscripts(phi, 1) - 1 AS pos FROM rec), o AS (SELECT eid, pos, row_number() OVER (PARTITION BY eid ORDER BY v DESC, pos) AS k FROM l)
SELECT eid, string_agg(CAST(pos AS VARCHAR), '|' ORDER BY k) AS best FROM o WHERE k <= 2 GROUP BY eid""")
def f4_top_places(spark, sf):
    return records(spark, sf).select("eid", reports.piped(stats.top_k(F.col("phi"), 2).cast("array<string>")).alias("best"))


@query(f"""WITH {REC}, l AS (SELECT eid, unnest(['bytes', 'ports', 'timing', 'flags']) AS grp, unnest(phi) AS phi FROM rec), g AS (SELECT grp, min(phi) AS lo, max(phi) AS hi FROM l GROUP BY grp)
SELECT eid, grp, round(CASE WHEN hi > lo THEN (phi - lo) / (hi - lo) ELSE 0.5 END, 6) AS scaled FROM l JOIN g USING (grp)""")
def h20_unit_scaled(spark, sf):
    return reports.unit_scaled(attribution.long_form(records(spark, sf)), "phi", "grp").select("eid", "grp", r("scaled").alias("scaled"))


@query("SELECT o_orderkey, len(string_split(concat(o_orderstatus, '|', o_orderpriority), '|')) AS parts, trim(o_orderpriority) AS second FROM orders")
def h25_piped_lists(spark, sf):
    text = reports.piped(F.array("o_orderstatus", "o_orderpriority"))
    back = reports.parsed(text)
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.size(back).cast("long").alias("parts"), F.element_at(back, 2).alias("second"))


@query(f"""WITH {REC}, v AS (SELECT concat('v', eid % 4) AS variant, avg(confidence) AS score FROM rec GROUP BY 1)
SELECT variant, round(score, 6) AS score, round(score - (SELECT score FROM v WHERE variant = 'v0'), 6) AS delta FROM v""")
def j18_ablation_deltas(spark, sf):
    scores = records(spark, sf).groupBy(F.concat(F.lit("v"), (F.col("eid") % 4).cast("string")).alias("variant")).agg(F.avg("confidence").alias("score"))
    return reports.ablation_table(scores, "v0").select("variant", r("score").alias("score"), r("delta").alias("delta"))


@query(f"WITH {REC} SELECT eid, CASE WHEN eid % 6 > 0 THEN round(greatest(abs(phi[1] - phi[4]), abs(phi[2] - phi[3])), 6) END AS delta FROM rec")
def j20_largest_change(spark, sf):
    empty = F.when(F.col("eid") % 6 > 0, F.reverse("phi"))
    return records(spark, sf).select("eid", r(reports.largest_change(F.col("phi"), empty)).alias("delta"))
