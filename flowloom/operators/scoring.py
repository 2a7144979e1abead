"""Edge scoring by message passing, backgrounds per class, and a logistic scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_backgrounds(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """label, pos, mean: the mean vector of each class. [D2, A10]"""
    return rows.select(label, F.posexplode(vector).alias("pos", "v")).groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def state_backgrounds(states: DataFrame, dims: list[str], cls: str = "cls") -> DataFrame:
    """cls and the mean of the two ends' states in each dimension. [D3]"""
    return states.groupBy(cls).agg(*[F.avg((F.col(f"src_{d}") + F.col(f"dst_{d}")) / 2).alias(d) for d in dims])


def mean_aggregate(edges: DataFrame, nodes: DataFrame, dims: list[str]) -> DataFrame:
    """node and the mean of its in-neighbours' dimensions (0 without any): one step of message passing. [J13]

    Parallel edges are summed up per pair before the join, so a hot pair sends one row.
    """
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("_k"))
    sent = pairs.join(nodes.withColumnRenamed("node", "src"), "src")
    got = sent.groupBy(F.col("dst").alias("node")).agg(F.sum("_k").alias("_n"), *[F.sum(F.col(d) * F.col("_k")).alias(d) for d in dims])
    mean = got.select("node", *[(F.col(d) / F.col("_n")).alias(f"mean_{d}") for d in dims])
    return nodes.join(mean, "node", "left").select("node", *dims, *[F.coalesce(f"mean_{d}", F.lit(0.0)).alias(f"mean_{d}") for d in dims])


def sage_layer(edges: DataFrame, nodes: DataFrame, dims: list[str], own: list[list[float]], near: list[list[float]]) -> DataFrame:
    """node, h0, h1, ...: relu(own @ x + near @ mean of in-neighbours). [J13]"""
    m = mean_aggregate(edges, nodes, dims)
    unit = lambda a, b: F.greatest(F.lit(0.0), sum(F.col(d) * v for d, v in zip(dims, a)) + sum(F.col(f"mean_{d}") * v for d, v in zip(dims, b)))
    return m.select("node", *[unit(a, b).alias(f"h{i}") for i, (a, b) in enumerate(zip(own, near))])


def edge_logits(edges: DataFrame, hidden: DataFrame, units: int, weights: list[float], bias: float) -> DataFrame:
    """eid, logit of a linear head over both ends' units. [J13, C6]"""
    a = hidden.select(F.col("node").alias("src"), *[F.col(f"h{i}").alias(f"s{i}") for i in range(units)])
    b = hidden.select(F.col("node").alias("dst"), *[F.col(f"h{i}").alias(f"d{i}") for i in range(units)])
    names = [f"s{i}" for i in range(units)] + [f"d{i}" for i in range(units)]
    return edges.join(a, "src").join(b, "dst").select("eid", (sum(F.col(n) * w for n, w in zip(names, weights)) + bias).alias("logit"))


def train_classifier(rows: DataFrame, features: list[str], label: str, weight: str | None = None, steps: int = 50, regularisation: float = 1e-4):
    """A weighted multinomial logistic model of MLlib, the trainer of this engine. [J14]"""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    fit = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=steps, regParam=regularisation, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), fit]).fit(rows)


def predictions(model, rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, predicted, probability (array). [C9]"""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select(*keep, F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability").alias("probability"))
