"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. The field scores a line's label by features of the line and of its neighbours, and each pair
of adjacent labels by a transition weight. Forward-backward gives the marginal probability that a line is good; the
marginals, weighted by line length, make the document's mean, which a logistic curve fitted on the training documents
turns into the probability of label 1.

Training takes SAMPLE_DOCS labelled documents at most, in the order of a hash of the id, and of these whole documents while
all their lines stay within SAMPLE_LINES; this bounds the driver's memory. All else covers all documents and whole
texts. Line labels start as the document's; then the field relabels the lines of bad documents that it finds good, and is
fitted once more. For the fit, a document's chain is parted after every CHAIN_LINES lines: each line keeps the features of both
its neighbours, and only the transition at the cut isn't counted.

Defined results: a null or empty text is one empty line and is scored like any other; no labelled rows give every
document score 1.0 (nothing is rejected); of a doc_id's conflicting labels the larger counts, and of its different texts the one
of the least hash trains; ids may have any type; rows are scored one by one, so repeats and ties agree; very long texts
are scored whole, one at a time; an empty table gives no rows; extra columns pass.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.plans.scratch import written

SAMPLE_DOCS, SAMPLE_LINES = 4000, 200_000
#: Lines of a chain in training.
CHAIN_LINES = 64
#: Documents of this score or more are accepted.
ACCEPT = 0.3
SYMBOLS = re.compile(r"[#$%&*+=<>@\\^_~|]")
FEATURES = ("log_words", "symbols", "marked_words", "bars", "bangs", "capitals", "digits", "distinct", "pairs", "same_next", "word_length", "one_letter", "sentence", "seen_before", "end_mark")
N = len(FEATURES)


def line_features(line: str, seen: int) -> list[float]:
    """The features of one line; ``seen``: how often it stood earlier in the document."""
    words = line.split(" ")
    n, size = len(words), max(1, len(line))
    marks = len(SYMBOLS.findall(line))
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    same = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    # a word of an ever-growing line repeats: the share of distinct words is held against what that length would give
    return [
        np.log1p(n), marks / size, min(1.0, marks / n), line.count("|") / n, line.count("!!") / n, sum(map(str.isupper, words)) / n,
        sum(map(str.isdigit, words)) / n, np.log((distinct + 1) / (n**0.85 + 1)), pairs / max(1, n - 1), same / n, min(20.0, size / n) / 10,
        sum(len(w) < 2 for w in words) / n, float(line[:1].isupper()), min(5, seen) / 5, float(line[-1:] in ".?!"),
    ]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line, and line lengths."""
    lines = (text or "").split("\n")
    seen: dict[str, int] = {}
    rows = np.empty((len(lines), N))
    for i, line in enumerate(lines):
        rows[i] = line_features(line, seen.get(line, 0))
        seen[line] = seen.get(line, 0) + 1
    return rows, np.array([len(x) + 1 for x in lines], float)


def _design(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((rows - mean) / scale, -6, 6)
    out = np.zeros((len(z), 3 * N + 1))
    out[:, :N] = z
    out[1:, N : 2 * N] = z[:-1]
    out[:-1, 2 * N : 3 * N] = z[1:]
    out[:, -1] = 1
    return out


def marginals(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability that each line is good. ``scores``: log odds of good by line alone; ``trans[a, b]``: from label a to label b."""
    n = len(scores)
    if n == 1:
        return 1 / (1 + np.exp(-scores))
    # a chain of two labels needs log odds only: messages from the left and from the right
    (t00, t01), (t10, t11) = trans.tolist()
    s = scores.tolist()
    left, right = [0.0] * n, [0.0] * n
    for i in range(1, n):
        x = left[i - 1] + s[i - 1]
        left[i] = _odds(x, t00, t01, t10, t11)
    for i in range(n - 2, -1, -1):
        x = right[i + 1] + s[i + 1]
        right[i] = _odds(x, t00, t10, t01, t11)
    return 1 / (1 + np.exp(-np.clip(scores + left + right, -60, 60)))


def _odds(x: float, bad_bad: float, bad_good: float, good_bad: float, good_good: float) -> float:
    """Log odds that a neighbour sends on when its own are x."""
    x = max(-60.0, min(60.0, x))
    return _log_add(bad_good, x + good_good) - _log_add(bad_bad, x + good_bad)


def _log_add(a: float, b: float) -> float:
    top = a if a > b else b
    return top + math.log(math.exp(a - top) + math.exp(b - top))


class Model:
    """Weights of the field and of the logistic curve; ``None`` weights score everything 1.0."""

    def __init__(self, mean=None, scale=None, weights=None, trans=None, curve=(0.0, 0.0)):
        self.mean, self.scale, self.weights, self.trans, self.curve = mean, scale, weights, trans, curve

    def mean_good(self, rows: np.ndarray, lengths: np.ndarray) -> float:
        """The length-weighted mean of the marginals."""
        good = marginals(_design(rows, self.mean, self.scale) @ self.weights, self.trans)
        return float((good * lengths).sum() / lengths.sum())

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 1.0
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * _logit(self.mean_good(*document_features(text))) + b))))

    def as_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()})

    @classmethod
    def from_json(cls, text: str) -> Model:
        got = json.loads(text)
        return cls(**{k: np.array(v) if isinstance(v, list) and k != "curve" else v for k, v in got.items()})


def _logit(p: float) -> float:
    p = min(1 - 1e-4, max(1e-4, p))
    return float(np.log(p / (1 - p)))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 2, steps: int = 120) -> Model:
    """Fits the field by gradient ascent on its likelihood, all chains side by side, then the curve."""
    if not len(docs):
        return Model()
    if len(set(labels.tolist())) < 2:
        return Model() if labels[0] == 1 else Model(np.zeros(N), np.ones(N), np.zeros(3 * N + 1), np.zeros((2, 2)), (0.0, -3.0))
    every = np.concatenate([d[0] for d in docs])
    mean, scale = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-3)
    x = [_design(d[0], mean, scale) for d in docs]
    y = [np.full(len(d), float(label)) for d, label in zip(x, labels)]
    # the chains, longest first: (document, first line)
    chains = sorted(((i, at) for i, d in enumerate(x) for at in range(0, len(d), CHAIN_LINES)), key=lambda c: -min(CHAIN_LINES, len(x[c[0]]) - c[1]))
    sizes = np.array([min(CHAIN_LINES, len(x[i]) - at) for i, at in chains])
    longest = int(sizes[0])
    live = [int((sizes > t).sum()) for t in range(longest)]
    by_time = [np.stack([x[i][at + t] for i, at in chains[: live[t]]]) for t in range(longest)]
    # a bad document weighs as much as the good ones that outnumber it do, at most fivefold
    balance = min(5.0, max(1.0, (labels == 1).sum() / max(1, (labels == 0).sum())))
    weight = np.array([1.0 if labels[i] == 1 else balance for i, _ in chains])
    w, trans = np.zeros(3 * N + 1), np.zeros((2, 2))
    for turn in range(rounds):
        truth = [np.array([y[i][at + t] for i, at in chains[: live[t]]]) for t in range(longest)]
        w, trans = _ascend(by_time, truth, live, weight, w, trans, steps)
        if turn + 1 < rounds:
            for i in np.flatnonzero(labels == 0):
                good = marginals(x[i] @ w, trans)
                y[i] = (good > 0.6).astype(float) if (good <= 0.6).any() else y[i]
    model = Model(mean, scale, w, trans)
    means = np.array([_logit(model.mean_good(*d)) for d in docs])
    model.curve = _curve(means, labels.astype(float))
    return model


def _ascend(by_time, truth, live, weight, w, trans, steps):
    """Adam on the conditional log likelihood; forward-backward runs over lines, vectorised over chains."""
    longest, n = len(by_time), live[0]
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    lines = sum(live)
    for step in range(1, steps + 1):
        unary = [f @ w for f in by_time]
        alpha, beta = [], [None] * longest
        alpha.append(np.stack([np.zeros(n), unary[0]], axis=1))
        for t in range(1, longest):
            k = live[t]
            into = np.logaddexp(alpha[-1][:k, :1] + trans[0], alpha[-1][:k, 1:] + trans[1])
            into[:, 1] += unary[t]
            alpha.append(into)
        total = np.zeros(n)
        for t in range(longest - 1, -1, -1):
            k = live[t]
            after = np.zeros((k, 2))
            if t + 1 < longest and live[t + 1]:
                j = live[t + 1]
                ahead = beta[t + 1].copy()
                ahead[:, 1] += unary[t + 1]
                after[:j] = np.logaddexp(trans[:, 0] + ahead[:, :1], trans[:, 1] + ahead[:, 1:])
            beta[t] = after
        total = np.logaddexp.reduce(alpha[0] + beta[0], axis=1)
        grad, grad_t = np.zeros(len(w)), np.zeros((2, 2))
        for t in range(longest):
            k = live[t]
            good = np.exp(alpha[t][:, 1] + beta[t][:, 1] - total[:k])
            grad += ((truth[t] - good) * weight[:k]) @ by_time[t]
            if t + 1 < longest:
                j = live[t + 1]
                ahead = beta[t + 1].copy()
                ahead[:, 1] += unary[t + 1]
                for a in (0, 1):
                    for b in (0, 1):
                        p = np.exp(alpha[t][:j, a] + trans[a, b] + ahead[:, b] - total[:j])
                        real = (truth[t][:j] == a) * (truth[t + 1] == b)
                        grad_t[a, b] += ((real - p) * weight[:j]).sum()
        g = np.concatenate([grad, grad_t.ravel()]) / lines
        g -= 1e-4 * np.concatenate([w, trans.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, trans = w + move[:-4], np.clip(trans + move[-4:].reshape(2, 2), -3, 3)
    return w, trans


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        q = p * (1 - p) + 1e-9
        ga, gb = ((y - p) * x).sum() - 0.01 * a, (y - p).sum() - 0.01 * b
        haa, hab, hbb = (q * x * x).sum() + 0.01, (q * x).sum(), q.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    return max(a, 0.0), b


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the document's labels are kept from training: crc32 of its id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Model:
    """A model from labelled documents that aren't held out: ``sample_docs`` at most, whole, of ``sample_lines`` lines together at most."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("_label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.groupBy("doc_id").agg(F.max("_label").alias("_label")).orderBy(*order).limit(sample_docs)
    # sample_docs rows: a broadcast of proven size; one text for each id
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("_label").alias("_label"), F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("_t"))
    texts = written(texts.select(F.col("doc_id").cast("string").alias("doc_id"), "_label", "_t.text", *[o.alias(f"_o{i}") for i, o in enumerate(order)]), "training-texts")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    fit_in, total = [], 0
    for r in texts.select("doc_id", lines.alias("n"), "_o0", "_o1").orderBy("_o0", "_o1").collect():  # sample_docs short rows at most
        if total + r["n"] <= sample_lines:
            fit_in.append(r["doc_id"])
            total += r["n"]

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [document_features(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["_label"], "rows": [r.ravel() for r, _ in made], "lengths": [n for _, n in made]})

    taken = texts.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in fit_in], "doc_id string")), "doc_id").select("doc_id", "_label", "text")
    got = sorted(taken.mapInPandas(featured, "doc_id string, label int, rows array<double>, lengths array<double>").collect(), key=lambda r: r["doc_id"])  # sample_lines lines at most
    return fit([(np.array(r["rows"]).reshape(-1, N), np.array(r["lengths"])) for r in got], np.array([r["label"] for r in got]))


def score_column(model: Model, text: Column) -> Column:
    """The probability of label 1 of each whole text."""
    packed = model.as_json()

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model.from_json(packed)
        for texts in batches:
            yield texts.map(own.score, na_action=None).astype(float)

    return score(text)


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the column score (an input column of that name is replaced)."""
    return docs.drop("score").withColumn("score", score_column(model, docs[text]))
