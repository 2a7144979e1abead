"""flowloom: temporal flow-graph analytics written as Spark DataFrame jobs."""
