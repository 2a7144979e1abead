"""Fitting the edge scorer: gradients of the message passing network summed over partitions, epoch by epoch. [J14]

``packed`` turns flow contexts into rows of numbers, written once. In each epoch every task runs its rows through the
network forward and backward, as one block of nodes and links, and returns one vector: the gradient of the class-weighted
cross entropy over its training rows, and the confusion counts of its validation rows. Spark adds the vectors up per
entry, in fixed point, so the sum doesn't depend on the order of tasks; the driver holds the weights (some hundred numbers)
and takes one step of Adam. Fitting stops when the validation macro-F1 hasn't risen by more than ``tolerance`` for
``patience`` epochs, and the best weights are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.flow_games import DIMS, Scorer
from flowloom.plans.scratch import written

#: Fixed point of summed gradients.
UNIT = 2.0**40
#: Tasks of an epoch at most: the training rows are a bounded sample.
PARTS = 16


def packed(context: DataFrame, part: str = "part") -> DataFrame:
    """seed_eid, label, part, ends, x, hop, source, target: links and ends as places among the row's nodes, ``x`` their states end to end.

    ``context`` is that of ``flow_context`` with ``part`` ("train" or "val").
    """
    place = lambda node: (F.array_position("names", node) - 1).cast("int")
    links = F.coalesce("links", F.array().cast(context.schema["links"].dataType))
    rows = context.withColumns({"names": F.transform("nodes", lambda n: n["node"]), "links": links}).select(
        "seed_eid", "label", F.col(part).alias("part"), F.array(place(F.col("seed_src")), place(F.col("seed_dst"))).alias("ends"), F.flatten(F.transform("nodes", lambda n: n["x"])).alias("x"),
        F.transform("links", lambda x: x["hop"]).alias("hop"), F.transform("links", lambda x: place(x["src"])).alias("source"), F.transform("links", lambda x: place(x["dst"])).alias("target"),
    )
    return written(rows.repartition(PARTS, "seed_eid").sortWithinPartitions("seed_eid"), "packed")


@dataclass(frozen=True)
class Shape:
    """The network's sizes, and its weights as one vector: layers (own, near) from the furthest hop on, head, bias."""

    depth: int
    units: int
    classes: int
    dims: int = len(DIMS)

    def sizes(self) -> list[tuple[int, ...]]:
        layers = [s for i in range(self.depth) for s in [(self.units, self.units if i else self.dims)] * 2]
        return [*layers, (self.classes, 2 * self.units), (self.classes,)]

    def parts(self, weights: np.ndarray) -> list[np.ndarray]:
        sizes = self.sizes()
        ends = np.cumsum([int(np.prod(s)) for s in sizes])
        return [part.reshape(s) for part, s in zip(np.split(weights, ends[:-1]), sizes)]

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.standard_normal(s) * np.sqrt(2 / (s[-1] + s[0])) if len(s) > 1 else np.zeros(s)).ravel() for s in self.sizes()])

    def scorer(self, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> Scorer:
        *layers, head, bias = self.parts(weights)
        return Scorer(list(zip(layers[::2], layers[1::2])), head, bias, centre, scale)


@dataclass
class Block:
    """Rows laid end to end: their nodes' states, links with places in the whole block, ends and labels."""

    x: np.ndarray
    hop: np.ndarray
    source: np.ndarray
    target: np.ndarray
    ends: np.ndarray
    label: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, dims: int = len(DIMS)) -> Block:
        numbers = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
        lengths = lambda name: batch.column(name).value_lengths().to_numpy(zero_copy_only=False)
        nodes = lengths("x") // dims
        base = np.cumsum(nodes) - nodes
        shift = np.repeat(base, lengths("hop"))
        return cls(numbers("x").reshape(-1, dims), numbers("hop"), numbers("source") + shift, numbers("target") + shift, numbers("ends").reshape(-1, 2) + base[:, None], batch.column("label").to_numpy(zero_copy_only=False))

    def mean(self, hop: int, h: np.ndarray, backward: bool = False) -> np.ndarray:
        """The mean of each node's sampled in-neighbours at ``hop``, or the transpose of that map."""
        here = self.hop == hop
        source, target = self.source[here], self.target[here]
        share = 1.0 / np.bincount(target, minlength=len(self.x))[target]
        out = np.zeros_like(h)
        if backward:
            np.add.at(out, source, h[target] * share[:, None])
        else:
            np.add.at(out, target, h[source] * share[:, None])
        return out


def forward(shape: Shape, weights: np.ndarray, block: Block) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Class probabilities of each row, each layer's input and its neighbours' mean; the last input is the last output."""
    *layers, head, bias = shape.parts(weights)
    states, means = [block.x], []
    for i in range(shape.depth):
        means.append(block.mean(shape.depth - i, states[-1]))
        states.append(np.maximum(0.0, states[-1] @ layers[2 * i].T + means[-1] @ layers[2 * i + 1].T))
    both = states[-1][block.ends].reshape(len(block.ends), -1)
    logits = both @ head.T + bias
    odds = np.exp(logits - logits.max(axis=1, keepdims=True)) if len(logits) else logits
    return odds / odds.sum(axis=1, keepdims=True), states, means


def loss_and_gradient(shape: Shape, weights: np.ndarray, block: Block, row_weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted cross entropy summed over the block's rows, and its gradient."""
    *layers, head, _ = shape.parts(weights)
    p, states, means = forward(shape, weights, block)
    rows = np.arange(len(p))
    loss = float(-(row_weights * np.log(np.maximum(p[rows, block.label], 1e-300))).sum())
    wrong = p.copy()
    wrong[rows, block.label] -= 1
    wrong *= row_weights[:, None]
    both = states[-1][block.ends].reshape(len(p), -1)
    out = [wrong.T @ both, wrong.sum(axis=0)]
    back = np.zeros_like(states[-1])
    np.add.at(back, block.ends.ravel(), (wrong @ head).reshape(-1, shape.units))
    for i in reversed(range(shape.depth)):
        back = back * (states[i + 1] > 0)
        out = [back.T @ states[i], back.T @ means[i], *out]
        back = back @ layers[2 * i] + block.mean(shape.depth - i, back @ layers[2 * i + 1], backward=True)
    return loss, np.concatenate([g.ravel() for g in out])


def _epoch(rows: DataFrame, shape: Shape, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray, class_weights: np.ndarray) -> np.ndarray:
    """Loss, total weight, gradient and the validation's confusion counts (true x predicted), summed over all rows."""
    n = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + n + shape.classes**2)
        for batch in batches:
            block = Block.of(batch)
            block.x = (block.x - centre) / scale
            train = batch.column("part").to_numpy(zero_copy_only=False) == "train"
            each = np.where(train, class_weights[block.label], 0.0)
            loss, gradient = loss_and_gradient(shape, weights, block, each)
            total[0] += loss
            total[1] += each.sum()
            total[2 : 2 + n] += gradient
            said = forward(shape, weights, block)[0].argmax(axis=1)
            total[2 + n :] += np.bincount(block.label[~train] * shape.classes + said[~train], minlength=shape.classes**2)
        yield pa.RecordBatch.from_arrays([pa.array([np.round(total * UNIT).astype(np.int64).tolist()], pa.list_(pa.int64()))], ["v"])

    sums = rows.mapInArrow(run, "v array<long>").select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(2 + n + shape.classes**2)
    for r in sums.collect():  # an entry per weight
        out[r["at"]] = r["v"] / UNIT
    return out


def macro_f1(confusion: np.ndarray) -> float:
    """Mean F1 over the classes that occur or are predicted; 0 without rows."""
    right, either = np.diag(confusion), confusion.sum(axis=0) + confusion.sum(axis=1)
    real = either > 0
    return float((2 * right[real] / either[real]).mean()) if real.any() else 0.0


@dataclass
class Fitted:
    scorer: Scorer
    #: epoch, train_loss, val_macro_f1, best so far
    history: list[tuple[int, float, float, bool]]


def input_scale(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each dimension over the training rows' nodes; 1 where a dimension is constant."""
    each = rows.filter("part = 'train'").select(F.posexplode("x").alias("at", "v")).groupBy((F.col("at") % len(DIMS)).alias("d")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    centre, scale = np.zeros(len(DIMS)), np.ones(len(DIMS))
    for r in each.collect():  # a row per dimension
        centre[r["d"]], scale[r["d"]] = r["m"], r["s"] if r["s"] > 1e-9 else 1.0
    return centre, scale


def fit(
    rows: DataFrame, classes: int, class_weights: list[float], depth: int = 2, units: int = 8, epochs: int = 40, rate: float = 0.02, patience: int = 5, tolerance: float = 1e-5, seed: int = 0,
) -> Fitted:
    """Fits on the ``packed`` rows of part "train", judged by those of part "val". A class without rows has weight 0 and no say."""
    shape, each = Shape(depth, units, classes), np.array(class_weights, dtype=float)
    centre, scale = input_scale(rows)
    weights = shape.start(seed)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    best, kept, since, history = -np.inf, weights, 0, []
    for epoch in range(1, epochs + 1):
        sums = _epoch(rows, shape, weights, centre, scale, each)
        if not sums[1]:
            break  # no training rows: the weights stay as they start
        score = macro_f1(sums[2 + len(weights) :].reshape(classes, classes))
        better = score > best + tolerance
        history.append((epoch, float(sums[0] / sums[1]), score, bool(better)))
        best, kept, since = (score, weights, 0) if better else (best, kept, since + 1)
        if since >= patience:
            break
        gradient = sums[2 : 2 + len(weights)] / sums[1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        weights = weights - rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
    return Fitted(shape.scorer(kept, centre, scale), history)
