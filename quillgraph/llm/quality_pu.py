"""Operator 1: a quality classifier from positives and unlabelled text (non-negative PU learning).

Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator" (2017): with g the score, l the
sigmoid loss l(g) = 1 / (1 + exp(g)) and p the share of good documents in the corpus,

    risk = p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]),

and where the second term falls below zero its gradient is ascended. Trusted positives are labelled documents of
quality 1 that are not toxic; the unlabelled set is every document of the corpus that has a text. Labels of bad documents
are never used. g >= 0 accepts.

p is estimated by best-bin estimation (Garg et al., 2021): over the thresholds of a first model, the least ratio of the
unlabelled to the positive share above it. The corpus is halved by a hash of the ids, and each half is scored by the
model of the other.

Only labelled rows are sampled: at most ``max_rows`` trusted positives, chosen by a hash of their ids. All else covers the
corpus: features (sixteen document statistics and hashed distinct words, scaled by the root of their number) are
extracted once and written in the shared folder; bin edges come from a mergeable histogram, and expectations over
unlabelled text and shares above thresholds from sums over all partitions, which are added up in two levels, so that the
driver receives about the root of their number. A step is one pass over the features. Scores are a scalar Arrow function
of the whole text, so filtering needs no shuffle and other columns never leave the JVM.

Edge cases: null and empty texts score -inf and are rejected; a corpus without two usable positives has no trusted
reference and every non-empty text is kept with score 0; rows that repeat are scored alike and count as often as they occur
in the unlabelled set; a null doc_id does not matter; a positive whose label repeats counts once; a doc_id with
conflicting labels is no positive; if a half has no positives the other estimates p alone, and without any p is 1/2.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, release, sample_ids, tidy
from .stats import NAMES, slice_stats
from .words import Slice, mix, slices, words

_TINY = np.float32(1e-8)
_NOBODY = -(1 << 63)


@dataclass(frozen=True)
class Options:
    max_rows: int = 6000  # trusted positives that are fitted on
    bins: int = 16
    word_bits: int = 14
    epochs: int = 12
    steps: int = 3  # an epoch; each is a pass over the corpus
    rate: float = 0.1
    decay: float = 2e-4
    beta: float = 0.0
    prior: float | None = None  # None: estimated


@dataclass(frozen=True)
class Model:
    edges: np.ndarray  # statistics x inner bin edges
    weights: np.ndarray  # words, then bins of each statistic, then the constant
    word_bits: int
    prior: float


def _words_used(part: Slice, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, and the distinct hashed words as (document, bucket) pairs."""
    w = words(part)
    stats = slice_stats(part, w)
    key = (w.doc().astype(np.uint64) << np.uint64(bits)) | (w.hash >> np.uint64(64 - bits))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return stats, (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def _binned(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, stats[:, j], "right") for j, e in enumerate(edges)], 1) if len(stats) else np.zeros((0, len(edges)), np.int64)


def _score_part(part: Slice, model: Model) -> np.ndarray:
    stats, doc, bucket = _words_used(part, model.word_bits)
    stats = stats.astype(np.float32)  # as in the fit
    n = len(stats)
    used = np.maximum(np.bincount(doc, minlength=n), 1)
    score = np.bincount(doc, model.weights[bucket], minlength=n) / np.sqrt(used)
    width = model.edges.shape[1] + 1
    base = (1 << model.word_bits) + np.arange(len(model.edges)) * width
    score += model.weights[base + _binned(stats, model.edges)].sum(1) + model.weights[-1]
    score[np.diff(part.offsets) == 0] = -np.inf
    return score


def score_column(model: Model | None, text: Column) -> Column:
    """The score of each text as a double."""
    if model is None:
        return F.when(F.length(text) > 0, F.lit(0.0)).otherwise(F.lit(float("-inf")))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        parts = [_score_part(p, model) for p in slices(column)]
        release()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text)


_SLICE = "n int, ids binary, stats binary, at binary, words binary"


def _features(docs: DataFrame, bits: int) -> DataFrame:
    """A row for each slice of documents: ids, statistics, and hashed words with their bounds."""
    kind = np.uint16 if bits <= 16 else np.uint32

    def each(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NOBODY).to_numpy(zero_copy_only=False)
            for part in slices(batch.column("text")):
                stats, doc, bucket = _words_used(part, bits)
                at = np.searchsorted(doc, np.arange(len(stats) + 1)).astype(np.int32)
                row = [[len(stats)], [ids[part.lo : part.hi].astype(np.int64).tobytes()], [stats.astype(np.float32).tobytes()], [at.tobytes()], [bucket.astype(kind).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, [pa.int32()] + [pa.binary()] * 4, strict=True)], ["n", "ids", "stats", "at", "words"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    return kept(some.mapInArrow(tidy(each), _SLICE))


def _opened(batches, bits: int):
    """(ids, statistics, CSR bounds, words) of each slice."""
    kind = np.uint16 if bits <= 16 else np.uint32
    for batch in batches:
        for n, *raw in zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "stats", "at", "words")), strict=True):
            yield np.frombuffer(raw[0], np.int64, n), np.frombuffer(raw[1], np.float32).reshape(n, -1), np.frombuffer(raw[2], np.int32), np.frombuffer(raw[3], kind)


def _half(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) & np.uint64(1)).astype(np.int64)


def _edges(features: DataFrame, o: Options) -> np.ndarray:
    """Bin edges of each statistic: the corpus's quantiles, from its histogram over the leading 18 bits of the values (11 of
    them of the mantissa, so an edge is within a thousandth of its quantile), which are in the values' order."""

    def each(batches):
        for _, stats, _, _ in _opened(batches, o.word_bits):
            key = (np.maximum(stats, 0).view(np.uint32) >> np.uint32(12)).astype(np.int64) + (np.arange(stats.shape[1]) << 20)
            value, count = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count)], ["key", "n"])

    rows = features.mapInArrow(each, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    key, count = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    # An equal spacing but for some bins at the ends, where rare extremes are.
    shares = np.sort(np.concatenate((np.linspace(0, 1, o.bins - 3)[1:], [0.01, 0.99, 0.995])))
    out = []
    for j in range(len(NAMES)):
        mine = key >> 20 == j
        value = ((key[mine] & ((1 << 20) - 1)) << 12).astype(np.uint32).view(np.float32).astype(float)
        total = np.cumsum(count[mine])
        out.append(value[np.searchsorted(total, np.minimum(shares * total[-1], total[-1]))])
    return np.stack(out)


def _chosen(features: DataFrame, ids: np.ndarray, bits: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(id, statistics, words) of the documents of the given ids, which Options.max_rows bounds; one an id."""

    def each(batches):
        for own, stats, at, found in _opened(batches, bits):
            rows = np.flatnonzero(np.isin(own, ids))
            yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array([stats[i].tobytes() for i in rows], pa.binary()), pa.array([found[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())], ["doc_id", "stats", "words"])

    rows = features.mapInArrow(each, "doc_id long, stats binary, words binary").toArrow().to_pylist()
    once = {r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["doc_id"], r["stats"], r["words"]), reverse=True)}
    kind = np.uint16 if bits <= 16 else np.uint32
    return [(i, np.frombuffer(once[i]["stats"], np.float32), np.frombuffer(once[i]["words"], kind)) for i in sorted(once)]


def _csr(stats: np.ndarray, at: np.ndarray, found: np.ndarray, edges: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, feature numbers and values: words, then a bin of each statistic, then the constant."""
    n, k = stats.shape
    width = edges.shape[1] + 1
    bins = (1 << bits) + np.arange(k) * width + _binned(stats, edges)
    size = np.diff(at)
    bounds = np.concatenate(([0], np.cumsum(size + k + 1))).astype(np.int64)
    idx, val = np.empty(bounds[-1], np.int32), np.ones(bounds[-1], np.float64)
    place = np.arange(len(found)) + np.repeat(np.arange(n) * (k + 1), size)
    idx[place], val[place] = found, np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)
    rest = (bounds[1:] - k - 1)[:, None] + np.arange(k + 1)
    idx[rest[:, :k]], idx[rest[:, k]] = bins, (1 << bits) + k * width
    return bounds, idx, val


def _scores(x: tuple, w: np.ndarray) -> np.ndarray:
    bounds, idx, val = x
    return np.bincount(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), w[idx] * val, minlength=len(bounds) - 1)


def _spread(x: tuple, each: np.ndarray, width: int) -> np.ndarray:
    """The features' sum, weighted by a number of each row."""
    bounds, idx, val = x
    return np.bincount(idx, np.repeat(each, np.diff(bounds)) * val, minlength=width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _moments(x: tuple, w: np.ndarray) -> np.ndarray:
    """Number of rows, sum of s = sigmoid(g), and sum of ds/dw = s (1 - s) x, as one vector."""
    s = _sigmoid(_scores(x, w))
    return np.concatenate(([len(s), s.sum()], _spread(x, s * (1 - s), len(w))))


def _descend(positives: list[tuple], unlabelled, width: int, priors: list[float], o: Options) -> list[np.ndarray]:
    """Weights of one model for each set of positives, by Adam on the non-negative risk; ``unlabelled(weights)`` gives the
    moments of each model's unlabelled rows, all in one pass."""
    total = o.epochs * o.steps
    ws, ms, vs = ([np.zeros(width) for _ in positives] for _ in range(3))
    for step in range(total):
        for k, (xp, prior, mu) in enumerate(zip(positives, priors, unlabelled(ws), strict=True)):
            mp = _moments(xp, ws[k])
            if not mp[0] or not mu[0]:
                continue
            # d l(g)/dg = -s (1 - s) and d l(-g)/dg = s (1 - s).
            negative, pull = mu[1] / mu[0] - prior * mp[1] / mp[0], prior * mp[2:] / mp[0]
            rest = mu[2:] / mu[0] - pull
            grad = (-rest if negative < -o.beta else rest - pull) + o.decay * ws[k]  # a step back on the term that has overfitted
            ms[k], vs[k] = 0.9 * ms[k] + 0.1 * grad, 0.99 * vs[k] + 0.01 * grad * grad
            rate = o.rate * (1 - step / total + 0.02)
            ws[k] = ws[k] - rate * (ms[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(vs[k] / (1 - 0.99 ** (step + 1))) + _TINY)
    return ws


def nnpu(xp: tuple, xu: tuple, width: int, prior: float, o: Options) -> np.ndarray:
    """Weights that minimise the non-negative risk of rows in memory."""
    return _descend([xp], lambda ws: [_moments(xu, ws[0])], width, [prior], o)[0]


def _summed(features: DataFrame, vector) -> np.ndarray:
    """The sum over all slices of ``vector(ids, stats, at, words)``, added up within partitions, then in two levels."""
    bits = vector.bits

    def each(batches):
        total = None
        for part in _opened(batches, bits):
            own = vector(*part)
            total = own if total is None else total + own
        yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], ["v"])

    def add(batches):
        total = None
        for batch in batches:
            for raw in batch.column("v").to_pylist():
                total = np.frombuffer(raw) if total is None else total + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], ["v"])

    parts = features.mapInArrow(each, "v binary")
    few = math.isqrt(max(1, int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = parts.repartition(few).mapInArrow(add, "v binary").toArrow().column("v").to_pylist()
    return np.sum([np.frombuffer(r) for r in sorted(rows)], axis=0)


class _Vector:
    """What a pass sums: moments of models over their halves, or rows above cuts. ``halves`` is None for all rows."""

    def __init__(self, ws: list[np.ndarray], edges: np.ndarray, bits: int, halves: list[int] | None, cuts: list[np.ndarray] | None = None) -> None:
        self.ws, self.edges, self.bits, self.halves, self.cuts = ws, edges, bits, halves, cuts

    def __call__(self, ids, stats, at, found) -> np.ndarray:
        n, width = len(ids), len(self.ws[0])
        model = np.zeros(n, np.int64) if self.halves is None else np.array(self.halves)[_half(ids)]  # whose weights a row meets
        weights = np.concatenate(self.ws)
        size = np.diff(at)
        scale = 1 / np.sqrt(np.maximum(size, 1))
        idx = found.astype(np.int64)
        if len(self.ws) > 1:
            idx += np.repeat(model * width, size)
        bins = (1 << self.bits) + np.arange(stats.shape[1]) * (self.edges.shape[1] + 1) + _binned(stats, self.edges) + (model * width)[:, None]
        g = weights[bins].sum(1) + weights[model * width + width - 1]
        some = np.flatnonzero(size)
        if len(some):
            g[some] += np.add.reduceat(weights[idx], at[some]) * scale[some]
        out = []
        if self.cuts is not None:
            for k in range(len(self.ws)):
                own = np.sort(g[model == k])
                out.append(np.concatenate(([len(own)], len(own) - np.searchsorted(own, self.cuts[k]))).astype(float))
            return np.concatenate(out)
        s = _sigmoid(g)
        each = s * (1 - s)
        total = np.bincount(idx, np.repeat(each * scale, size), minlength=len(weights)) + np.bincount(bins.ravel(), np.repeat(each, stats.shape[1]), minlength=len(weights))
        for k in range(len(self.ws)):
            mine = model == k
            own = total[k * width : (k + 1) * width]
            own[-1] += each[mine].sum()
            out += [[float(mine.sum()), s[mine].sum()], own]
        return np.concatenate(out)


def best_bin_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """Least upper confidence of (unlabelled share above c) / (positive share above c) over thresholds c."""
    cuts = np.sort(pos)
    return _best_bin(len(cuts), len(unl) - np.searchsorted(np.sort(unl), cuts), len(unl), delta)


def _best_bin(n: int, above: np.ndarray, total: float, delta: float = 0.1) -> float:
    """The estimate from how many of ``total`` unlabelled scores reach each of n positive ones, in rising order. The
    confidence follows the shares' own variance (Bernstein's bound): where nearly all positives are above, their share is
    nearly certain, which one width for all thresholds would not see."""
    fp = 1 - np.arange(n) / n
    fu = above / total
    log = np.log(4 / delta)
    slack = sum(np.sqrt(2 * f * (1 - f) * log / m) + log / (3 * m) for f, m in ((fp, n), (fu, total)))
    best = np.argmin((fu + slack) / fp)
    return float(np.clip(fu[best] / fp[best], 0, 1))


def fit(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> Model | None:
    o, bits = options, options.word_bits
    by = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    ids = sample_ids(by.where("q = 1 AND x = 0").select("doc_id"), o.max_rows, "trusted").toArrow().column("doc_id").to_numpy()
    if len(ids) < 2:
        return None
    features = _features(docs, bits)
    pos = _chosen(features, ids, bits)
    if len(pos) < 2:
        return None
    edges = _edges(features, o)
    width = (1 << bits) + len(NAMES) * (edges.shape[1] + 1) + 1

    def csr(rows: list) -> tuple:
        at = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows]))).astype(np.int64)
        return _csr(np.stack([r[1] for r in rows]) if rows else np.zeros((0, len(NAMES)), np.float32), at, np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int64), edges, bits)

    def corpus(halves):
        return lambda ws: np.split(_summed(features, _Vector(ws, edges, bits, halves)), len(ws))

    prior = o.prior
    if prior is None:
        half = _half(np.array([r[0] for r in pos], np.int64))
        parts = [csr([r for r, h in zip(pos, half, strict=True) if h == k]) for k in (0, 1)]
        first = _descend(parts, corpus([0, 1]), width, [0.5, 0.5], o)
        # Each half is scored by the other's model, so that no row's luck in the draw counts.
        cuts = [np.sort(_scores(parts[k], first[1 - k])) for k in (0, 1)]
        above = np.split(_summed(features, _Vector(first[::-1], edges, bits, [0, 1], cuts)), [1 + len(cuts[0])])
        found = [_best_bin(len(c), a[1:], a[0]) for c, a, other in zip(cuts, above, parts[::-1], strict=True) if len(c) and a[0] and len(other[0]) > 1]
        prior = float(np.mean(found)) if found else 0.5
    w = _descend([csr(pos)], corpus(None), width, [prior], o)[0]
    return Model(edges, w, bits, prior)


def accepted(docs: DataFrame, labels: DataFrame, options: Options = Options(), score: str | None = None) -> DataFrame:
    """The documents with a score of at least 0, in docs' own columns; ``score`` names an added column, if given, which
    takes the place of one that docs has by that name."""
    model = fit(docs, labels, options)
    scored = docs.select("*", score_column(model, docs["text"].cast("string")).alias("__quill_score"))
    kept = scored.where(F.col("__quill_score") >= 0)
    return (kept.withColumn(score, F.col("__quill_score")) if score else kept).drop("__quill_score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return accepted(docs.select("doc_id", "text"), labels, score="score").select("doc_id", "score")
