"""Streams against the batch operators."""

from pyspark.sql import functions as F

from flowloom.operators import state
from flowloom.sources.flows import events_flow, node_events
from flowloom.streaming.state_stream import STATE, class_counts, rolling_counts


def test_rolling_counts_equal_batch(spark, sf_dir, tmp_path):
    ne = node_events(events_flow(spark, sf_dir)).select("node", "ts", "incoming", "bytes", "bin", "peer", "eid")
    for i in range(2):
        half = ne.filter(F.col("eid").between(500 * i, 500 * i + 499))
        half.withColumn("at", F.timestamp_millis("ts")).select("node", "at", "incoming", "bytes").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("node long, at timestamp, incoming boolean, bytes double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    window = 6 * 3_600_000
    q = rolling_counts(stream, window).writeStream.format("memory").queryName("rolling").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["node"], int(r["ts"].timestamp() * 1000 + 0.5)): (r["in_degree"], r["out_degree"]) for r in spark.table("rolling").collect()}
    want = {(r["node"], r["ts"]): (r["in_degree"], r["out_degree"]) for r in state.rolling_state(ne, window).collect()}
    assert STATE and got == want


def test_class_counts(spark, tmp_path):
    spark.createDataFrame([(0, "a"), (10, "a"), (3_700, "b"), (20_000, "a"), (90_000, "a")], "s long, cls string").select(F.timestamp_seconds("s").alias("at"), "cls").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, cls string").parquet(str(tmp_path / "in"))
    q = class_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["cls"], r["n"]) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1), ("a", 1)}
