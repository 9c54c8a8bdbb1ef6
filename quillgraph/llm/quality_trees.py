"""Operator 2: quality rules by gradient-boosted trees over document statistics.

Logistic boosting on histogram bins, trees of a fixed depth. Chosen features are monotonic: a split that would break the
order is not made, and both children are bounded by the middle of their values from there on. The forest is flattened
into node arrays (feature, threshold, left, right, value); scoring walks all trees of all documents of a slice at once,
one numpy step a level. Leaves point to themselves, so no tree needs a test for its end.

Fitting takes at most ``max_rows`` labelled documents, chosen by a hash of their ids; scoring covers every document.

Edge cases: null and empty texts have all statistics 0 and are rejected; without labels of both kinds every non-empty
text scores 0.5 and is kept; a doc_id with conflicting labels counts as bad; labels of unknown or null quality, or
without a document, are left out; rows that repeat are scored alike; other columns are unread.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import release, sample_ids, tidy
from .stats import NAMES, column_stats

MONOTONIC = {"symbol_ratio": -1, "pipe_ratio": -1, "bang_ratio": -1, "repeat_next_ratio": -1, "repeat_line_ratio": -1, "symbol_word_ratio": -1, "upper_ratio": -1, "distinct_ratio": 1}


@dataclass(frozen=True)
class Options:
    max_rows: int = 20_000
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.1
    least_leaf: int = 8
    ridge: float = 1.0
    threshold: float = 0.5
    monotonic: dict = field(default_factory=lambda: dict(MONOTONIC))


@dataclass(frozen=True)
class Forest:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of quality."""
        node = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)


def fit_forest(x: np.ndarray, y: np.ndarray, o: Options = Options(), names: tuple[str, ...] = NAMES) -> Forest:
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, o.bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    sign = np.array([o.monotonic.get(name, 0) for name in names])
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    f = np.full(n, base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        total_g, total_h = g.sum(), h.sum()
        own = float(np.clip(-total_g / (total_h + o.ridge), low, high))
        if depth == 0 or len(rows) < 2 * o.least_leaf:
            return close(rows, own)
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j in range(k):
            size = len(edges[j]) + 1
            if size < 2:
                continue
            b = binned[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, minlength=size))[:-1] for w in (g, h, None))
            gr, hr, nr = total_g - gl, total_h - hl, len(rows) - nl
            vl, vr = np.clip(-gl / (hl + o.ridge), low, high), np.clip(-gr / (hr + o.ridge), low, high)
            part = lambda gg, hh, v: -(gg * v + 0.5 * (hh + o.ridge) * v * v)
            gain = part(gl, hl, vl) + part(gr, hr, vr) - part(total_g, total_h, own)
            gain[(nl < o.least_leaf) | (nr < o.least_leaf) | (sign[j] * (vr - vl) < 0)] = -np.inf
            t = int(np.argmax(gain))
            if gain[t] > best[0]:
                best = (float(gain[t]), j, t, float(vl[t]), float(vr[t]))
        if best[1] < 0:
            return close(rows, own)
        _, j, t, vl, vr = best
        here = len(nodes)
        nodes.append([j, float(edges[j][t]), 0, 0, 0.0])
        middle = (vl + vr) / 2
        bounds = ((low, high), (low, high))
        if sign[j] > 0:
            bounds = ((low, middle), (middle, high))
        elif sign[j] < 0:
            bounds = ((middle, high), (low, middle))
        go = binned[rows, j] <= t
        nodes[here][2] = grow(rows[go], depth - 1, *bounds[0])
        nodes[here][3] = grow(rows[~go], depth - 1, *bounds[1])
        return here

    def close(rows: np.ndarray, value: float) -> int:
        f[rows] += o.rate * value
        return leaf(o.rate * value)

    for _ in range(o.trees):
        p = 1 / (1 + np.exp(-f))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(grow(np.arange(n), o.depth, -np.inf, np.inf))
    columns = [np.array([node[i] for node in nodes]) for i in range(5)]
    return Forest(columns[0].astype(np.int64), columns[1].astype(float), columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4].astype(float), np.array(roots), o.depth, base)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and quality of at most max_rows labelled documents; the ids are bounded, so they are broadcast."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    ids = sample_ids(known.select("doc_id"), max_rows, "rules")
    chosen = F.broadcast(known.join(ids, "doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0").join(chosen, "doc_id")

    def each(batches):
        for batch in batches:
            x = column_stats(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "stats"])

    table = rows.select("doc_id", "quality", "text").mapInArrow(tidy(each), "doc_id long, quality int, stats binary").toArrow()
    once = sorted(set(zip(*(table.column(c).to_pylist() for c in ("doc_id", "quality", "stats")), strict=True)))
    x = np.stack([np.frombuffer(r[2], np.float64) for r in once]) if once else np.zeros((0, len(NAMES)))
    return x, np.array([r[1] for r in once], float)


def fit(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> Forest | None:
    x, y = training_rows(docs, labels, options.max_rows)
    return fit_forest(x, y, options) if len(y) and 0 < y.sum() < len(y) else None


def score_column(forest: Forest | None, text: Column) -> Column:
    """Probability of quality; 0 for null and empty texts."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        x = column_stats(column)
        release()
        p = 1 / (1 + np.exp(-forest.score(x))) if forest is not None else np.full(len(x), 0.5)
        return pa.array(np.where(np.any(x != 0, axis=1), p, 0.0))

    return score(text)


def accepted(docs: DataFrame, labels: DataFrame, options: Options = Options(), score: str = "score") -> DataFrame:
    """The documents that the rules keep, in docs' own columns, with their probability of quality as ``score``, in the
    place of a column of that name if there is one."""
    forest = fit(docs, labels, options)
    return docs.withColumn(score, score_column(forest, docs["text"].cast("string"))).where(F.col(score) >= options.threshold)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return accepted(docs.select("doc_id", "text"), labels).select("doc_id", "score")
