"""Graph relations: node dictionary, edges, roles, gateway distances, pivots, components, diameters."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.operators.components import connected_components
from flowloom.operators.ranges import numbered
from flowloom.plans.scratch import written


def node_dictionary(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """name, id: all endpoints in sorted order, from 0. [G1, G4, A9, J1]"""
    names = edges.select(F.col(src).alias("name")).union(edges.select(F.col(dst).alias("name"))).distinct()
    return numbered(names, ["name"], name="id")


def encoded_edges(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with src_id and dst_id beside the names; parallel edges stay. [C1, J1]"""
    a, b = nodes.select(F.col("name").alias(src), F.col("id").alias("src_id")), nodes.select(F.col("name").alias(dst), F.col("id").alias("dst_id"))
    return edges.join(a, src).join(b, dst)


def lookup(wanted: DataFrame, table: DataFrame, key: str = "eid") -> DataFrame:
    """Rows of ``table`` for each wanted key, repeats kept; an absent key is an error. [C3, C4, C5, M24]"""
    missing = wanted.join(table.select(key), key, "left_anti").limit(1).collect()
    if missing:
        raise KeyError(missing[0][key])
    return wanted.join(table, key)


def malicious(edges: DataFrame, benign: str = "view") -> DataFrame:
    """[B8]"""
    return edges.filter(F.col("cls") != benign)


def roles(edges: DataFrame, internal: Column) -> DataFrame:
    """node, is_internal, is_src, is_dst of the edges' endpoints; ``internal`` is a test of the column node. [D6]

    If no destination is internal, all destinations count as internal.
    """
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("s"), F.lit(0).alias("d")).union(edges.select("dst", F.lit(0), F.lit(1)))
    flat = ends.groupBy("node").agg((F.max("s") == 1).alias("is_src"), (F.max("d") == 1).alias("is_dst")).withColumn("is_internal", internal)
    some = flat.agg(F.max(F.col("is_internal") & F.col("is_dst")).alias("_some"))
    return flat.join(F.broadcast(some), F.lit(True)).withColumn("is_internal", F.when(F.col("_some"), F.col("is_internal")).otherwise(F.col("is_dst"))).drop("_some")


def gateway_distances(edges: DataFrame, node_roles: DataFrame) -> DataFrame:
    """node, d: steps from the nearest external source, along edges, however many; unreachable nodes are absent. [J6]

    A frontier join per step until a step finds no new node. Each step writes its new nodes only.
    """
    hops = written(edges.select("src", "dst").distinct().filter("src <> dst"), "hops")
    sources = edges.select(F.col("src").alias("node")).distinct().join(node_roles.filter("NOT is_internal").select("node"), "node")
    front = written(sources.withColumn("d", F.lit(0)), "front")
    reached, step = front, 0
    while True:
        step += 1
        next_ = front.join(hops, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = written(next_.join(reached, "node", "left_anti").withColumn("d", F.lit(step)), "front")
        if not front.limit(1).count():
            return reached
        reached = reached.unionByName(front)
        if step % 32 == 0:  # a plan of few files
            reached = written(reached, "reached")


def k_star(distances: DataFrame, most: int = 4) -> DataFrame:
    """One row: min(largest d + 1, most); ``most`` if nothing was reached. [J7]"""
    return distances.agg(F.coalesce(F.least(F.max("d") + 1, F.lit(most)), F.lit(most)).alias("k_star"), F.max("d").alias("max_d"))


def gateways(distances: DataFrame, node_roles: DataFrame) -> DataFrame:
    """Internal nodes one step from outside; chokepoint if there is one only. [J8]"""
    found = distances.filter("d = 1").join(node_roles.filter("is_internal").select("node"), "node").select("node")
    return found.withColumn("chokepoint", F.count("*").over(W.partitionBy()) == 1)


def pivots(edges: DataFrame, node_roles: DataFrame) -> DataFrame:
    """cls, node: internal nodes that receive and send; cls null over all classes. [G2]"""
    inside = node_roles.filter("is_internal").select("node")
    whole = edges.select(F.lit(None).cast("string").alias("cls"), F.col("dst").alias("node")).intersect(edges.select(F.lit(None).cast("string"), "src"))
    per = edges.select("cls", F.col("dst").alias("node")).intersect(edges.select("cls", "src"))
    return whole.unionByName(per).join(inside, "node", "left_semi")


def distance_stats(edges: DataFrame, distances: DataFrame, node_roles: DataFrame) -> DataFrame:
    """Per class (cls null over all): mean, max and deviation of d over its internal destinations, counts of nodes and of unreached ones. [D7, D8]"""
    dst = edges.select("cls", F.col("dst").alias("node")).distinct().join(node_roles.select("node", "is_internal"), "node").join(distances, "node", "left")
    whole = dst.select(F.lit(None).cast("string").alias("cls"), "node", "is_internal", "d").distinct()
    inside = lambda f: f(F.when(F.col("is_internal"), F.col("d")))
    return dst.select("cls", "node", "is_internal", "d").unionByName(whole).groupBy("cls").agg(
        inside(F.avg).alias("mean_d"), inside(F.max).alias("max_d"), inside(F.stddev_pop).alias("std_d"), F.count("*").alias("n_dst"), F.count_if(F.col("is_internal") & F.col("d").isNull()).alias("n_unreachable"),
    )


def component_sizes(edges: DataFrame) -> DataFrame:
    """component, nodes, links (distinct undirected). [J10]"""
    links = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).filter("u <> v").distinct()
    found = written(connected_components(links), "components")
    nodes = found.groupBy("component").agg(F.count("*").alias("nodes"))
    per = links.join(found, F.col("u") == F.col("node")).groupBy("component").agg(F.count("*").alias("links"))
    return nodes.join(per, "component")


def _farthest(near: dict, start) -> tuple:
    seen, queue, last = {start: 0}, deque([start]), start
    while queue:
        last = queue.popleft()
        for x in near[last]:
            if x not in seen:
                seen[x] = seen[last] + 1
                queue.append(x)
    return seen[last], last


def diameters(edges: DataFrame, most_nodes: int = 2000, most_links: int = 5000) -> DataFrame:
    """component, nodes, links, diameter, exact. [J9]

    Components within both limits are measured exactly, a task for each; of larger ones a lower bound comes from two sweeps
    by frontier joins, so no large component is gathered.
    """
    links = written(edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).filter("u <> v").distinct(), "links")
    found = written(connected_components(links), "components")
    sizes = written(component_sizes(edges), "sizes")
    small = sizes.filter((F.col("nodes") <= most_nodes) & (F.col("links") <= most_links))
    of = links.join(found, F.col("u") == F.col("node")).select("component", "u", "v")

    def measure(frame: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(frame["u"].tolist(), frame["v"].tolist()):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        return pd.DataFrame({"component": [frame["component"].iloc[0]], "diameter": [max(_farthest(near, x)[0] for x in near)]})

    kind = found.schema["component"].dataType.simpleString()
    exact = of.join(small.select("component"), "component", "left_semi").groupBy("component").applyInPandas(measure, f"component {kind}, diameter long").withColumn("exact", F.lit(True))
    large = sizes.join(small.select("component"), "component", "left_anti").select("component")
    if large.limit(1).count():
        both = written(of.join(large, "component", "left_semi").select("component", "u", "v").union(of.join(large, "component", "left_semi").select("component", "v", "u")), "both")
        starts = both.groupBy("component").agg(F.min("u").alias("node"))
        for _ in range(2):
            reach = written(starts.withColumn("d", F.lit(0)), "reach")
            step = 0
            while True:
                step += 1
                new = written(reach.filter(F.col("d") == step - 1).join(both.withColumnRenamed("u", "node"), ["component", "node"]).select("component", F.col("v").alias("node")).distinct().join(reach, ["component", "node"], "left_anti").withColumn("d", F.lit(step)), "front")
                if not new.limit(1).count():
                    break
                reach = written(reach.unionByName(new), "reach")
            ends = reach.groupBy("component").agg(F.max(F.struct("d", "node")).alias("m"))
            starts = written(ends.select("component", "m.node", F.col("m.d").alias("far")), "ends").drop("d")
            bound = starts.select("component", F.col("far").cast("long").alias("diameter"))
            starts = starts.select("component", "node")
        exact = exact.unionByName(bound.withColumn("exact", F.lit(False)))
    return sizes.join(exact, "component")
