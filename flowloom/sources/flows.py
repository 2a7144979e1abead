"""Flow tables: raw records read from CSV, and flow views over the driver's event, line item and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.encode import port_bin

# Column roles of the flow records.
NODE_COLUMNS = ["IPV4_SRC_ADDR", "IPV4_DST_ADDR"]
TIME_COLUMNS = ["FLOW_START_MILLISECONDS", "FLOW_END_MILLISECONDS"]
PORT_COLUMNS = ["L4_SRC_PORT", "L4_DST_PORT"]
LABEL_COLUMNS = ["Label", "Attack"]
REQUIRED_COLUMNS = [*NODE_COLUMNS, *PORT_COLUMNS]

#: Nodes of the second kind get ids above this, where a bipartite graph is wanted.
OFFSET = 1_000_000


def read_flows_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Raw flow records from CSV with a header. [A1, A2: only the columns that a query uses are parsed]"""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_flows_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Flow records or any stored artifact. [A4-A6, A9]"""
    return spark.read.parquet(path)


def write_by_split(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Parquet partitioned by split; returns the row count read back, and raises if it differs. [A3, A5]"""
    df.write.partitionBy("split").mode(mode).parquet(path)
    n, back = df.count(), df.sparkSession.read.parquet(path).count()
    if n != back:
        raise ValueError(f"wrote {n} rows, read {back}")
    return back


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without time zone."""
    return F.unix_millis(ts.cast("timestamp"))


def events_flow(spark: SparkSession, sf_dir: str, bipartite: bool = False) -> DataFrame:
    """eid, ts, src, dst, in_bytes, out_bytes, port, cls from ``events``: users talk to keys; 'view' is the benign class."""
    k = F.get_json_object("props", "$.k").cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("eid"), millis(F.col("ts")).alias("ts"), F.col("user_id").alias("src"), (k + OFFSET if bipartite else k).alias("dst"),
        F.col("value").alias("in_bytes"), F.col("value").alias("out_bytes"), F.pmod(F.col("event_id") * 7919, F.lit(65536)).cast("int").alias("port"), F.col("event_type").alias("cls"),
    )


def lineitem_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume view: suppliers send parts; days tie heavily. Has no eid: see ``with_eid``."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        millis(F.col("l_shipdate")).alias("ts"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") + OFFSET).alias("dst"), F.col("l_extendedprice").alias("in_bytes"),
        F.col("l_quantity").alias("out_bytes"), F.pmod(F.col("l_partkey") * 7919, F.lit(65536)).cast("int").alias("port"), F.col("l_returnflag").alias("cls"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def orders_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse view: customers to order priorities."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("eid"), millis(F.col("o_orderdate")).alias("ts"), F.col("o_custkey").alias("src"), (F.substring("o_orderpriority", 1, 1).cast("long") + OFFSET).alias("dst"),
        F.col("o_totalprice").alias("in_bytes"), F.col("o_totalprice").alias("out_bytes"), F.col("o_orderstatus").alias("cls"),
    )


def node_events(edges: DataFrame) -> DataFrame:
    """node, ts, incoming, bytes, bin, peer, eid: each edge writes an outgoing record at src and an incoming one at dst. [§1.1]"""
    out = F.struct(F.col("src").alias("node"), F.lit(False).alias("incoming"), F.col("out_bytes").alias("bytes"), port_bin(F.col("port")).alias("bin"), F.col("dst").alias("peer"))
    into = F.struct(F.col("dst").alias("node"), F.lit(True).alias("incoming"), F.col("in_bytes").alias("bytes"), F.lit(0).alias("bin"), F.col("src").alias("peer"))
    return edges.select("eid", "ts", F.explode(F.array(out, into)).alias("r")).select("r.node", "ts", "r.incoming", "r.bytes", "r.bin", "r.peer", "eid")
