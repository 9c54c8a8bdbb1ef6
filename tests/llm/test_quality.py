"""Both quality operators: held-out accuracy on labelled rows of their own making, and the awkward cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from quillgraph.llm import quality_pu as pu
from quillgraph.llm import quality_trees as trees

from .fixtures import awkward, frame, prose

GOOD = "the and of with river house reading paper morning evening people water letter".split()


def good(k):
    r = random.Random(k)
    return " ".join(r.choice(GOOD) + ("." if r.random() < 0.1 else "") for _ in range(r.randint(60, 200)))


def bad(k):
    r = random.Random(k)
    return " ".join(r.choice(["$$$", "|", "BUY", "!!!", "click", "##", "xx9"]) for _ in range(r.randint(30, 150)))


def corpus(spark, n=900, share=0.25):
    rows = [(i, bad(i) if i % round(1 / share) == 0 else good(i)) for i in range(n)]
    truth = {i: int(i % round(1 / share) != 0) for i in range(n)}
    labels = spark.createDataFrame([(i, truth[i], 0) for i in range(n) if i % 3], "doc_id long, quality int, toxic int")
    return rows, truth, labels


def accuracy(kept, truth):
    held_out = [i for i in truth if i % 3 == 0]
    return sum((i in kept) == bool(truth[i]) for i in held_out) / len(held_out)


def test_pu_held_out_accuracy(spark):
    rows, truth, labels = corpus(spark)
    out = pu.accepted(frame(spark, rows), labels, pu.Options(epochs=4))
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == frame(spark, []).columns
    assert accuracy(kept, truth) > 0.95
    assert np.mean([i in kept for i in truth if truth[i]]) > 0.98


def test_pu_needs_no_bad_labels(spark):
    rows, truth, labels = corpus(spark)
    flipped = labels.where("quality = 1")
    a, b = (pu.fit(frame(spark, rows), x, pu.Options(epochs=2)) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights)


def test_prior_estimate():
    r = np.random.default_rng(5)
    pos, unl = r.normal(2, 1, 3000), np.concatenate((r.normal(2, 1, 2100), r.normal(-2, 1, 900)))
    assert abs(pu.best_bin_prior(pos, unl) - 0.7) < 0.06


def test_the_risk_estimate_never_runs_away():
    """With a prior that is too high the unbiased risk falls without end; the non-negative one keeps the negatives apart."""
    r = np.random.default_rng(6)

    def csr(x):
        n, k = x.shape
        return np.arange(n + 1) * k, np.tile(np.arange(k, dtype=np.int32), n), x.astype(np.float32).ravel()

    make = lambda n, m: np.concatenate((r.normal(m, 1, (n, 8)), np.ones((n, 1))), 1)
    p, u, neg = make(200, 1), np.concatenate((make(300, 1), make(300, -1))), make(400, -1)
    w = pu.nnpu(csr(p), csr(u), 9, 0.5, pu.Options(epochs=10))
    assert np.isfinite(w).all() and (make(400, 1) @ w > 0).mean() > 0.9 and (neg @ w < 0).mean() > 0.9


def test_trees_held_out_accuracy(spark):
    rows, truth, labels = corpus(spark)
    kept = {r.doc_id for r in trees.accepted(frame(spark, rows), labels, trees.Options(trees=20), score="p").collect()}
    assert accuracy(kept, truth) > 0.97


@pytest.mark.parametrize("sign", [-1, 1])
def test_trees_are_monotonic(sign):
    r = np.random.default_rng(7)
    x = r.uniform(size=(2000, 3))
    y = ((sign * np.sin(9 * x[:, 0]) + x[:, 1] + r.normal(0, 0.3, 2000)) > 0.5).astype(float)
    forest = trees.fit_forest(x, y, trees.Options(monotonic={"a": sign}), ("a", "b", "c"))
    rest = r.uniform(size=(200, 2))
    steps = np.linspace(-0.2, 1.2, 60)
    scores = np.stack([forest.score(np.column_stack((np.full(200, s), rest))) for s in steps])
    assert (sign * np.diff(scores, axis=0) >= -1e-12).all() and np.ptp(scores[:, 0]) > 0
    free = trees.fit_forest(x, y, trees.Options(monotonic={}), ("a", "b", "c"))
    assert (np.diff(np.stack([free.score(np.column_stack((np.full(200, s), rest))) for s in steps]), axis=0) * sign < -1e-9).any()


def test_flat_forest_equals_a_walk():
    r = np.random.default_rng(8)
    x = r.normal(size=(500, 16))
    f = trees.fit_forest(x, (x[:, 3] * x[:, 5] > 0).astype(float))

    def walk(row):
        total = f.base
        for node in f.root:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            total += f.value[node]
        return total

    assert np.allclose(f.score(x[:80]), [walk(row) for row in x[:80]])
    assert ((f.score(x) > 0) == (x[:, 3] * x[:, 5] > 0)).mean() > 0.85


def test_awkward_rows(spark):
    rows, _, labels = corpus(spark, 300)
    more = awkward()
    odd = spark.createDataFrame([(None, 1, 0), (7, None, None), (5, 1, 0), (5, 1, 0), (9_999_999, 1, 0)], labels.schema)
    docs = frame(spark, [(None if i is None else 10_000 + i, t) for i, t in more] + rows)
    for out in (pu.accepted(docs, labels.unionByName(odd), pu.Options(epochs=2), score="mine"), trees.accepted(docs, labels.unionByName(odd), trees.Options(trees=5), score="mine")):
        got = out.select("doc_id", "text", "mine").collect()
        assert all(r.text for r in got)  # null and empty texts are rejected
        scores = {}
        for r in got:
            assert scores.setdefault(r.text, r.mine) == r.mine  # rows that repeat are scored alike


def test_nothing_to_learn_from(spark):
    docs = frame(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    filled = sum(bool(t) for _, t in awkward())
    assert pu.accepted(docs, none).count() == filled
    assert trees.accepted(docs, none, score="mine").count() == filled
    nobody = frame(spark, [])
    assert pu.accepted(nobody, none).count() == 0 == trees.accepted(nobody, none, score="mine").count()


def test_a_score_column_of_the_same_name_is_replaced(spark):
    rows, _, labels = corpus(spark, 200)
    docs = frame(spark, rows)
    for out in (trees.accepted(docs, labels, trees.Options(trees=5)), pu.accepted(docs, labels, pu.Options(epochs=2), score="score")):
        assert out.columns.count("score") == 1 and len(out.columns) == len(docs.columns)
        assert out.select("score").distinct().count() > 1
    assert pu.accepted(docs, labels, pu.Options(epochs=2)).where("score <> 0.5").count() == 0


def test_a_pass_over_the_corpus_sums_what_rows_in_memory_do(spark):
    """The fast sums over slices against the plain ones, for one model over all rows and for two over their halves."""
    rows, _, _ = corpus(spark, 120)
    bits = 8
    docs = frame(spark, rows + [(None, good(1)), (500, " \n ")])
    features = pu._features(docs, bits)
    edges = pu._edges(features, pu.Options())
    parts = list(pu._opened(features.toArrow().to_batches(), bits))
    width = (1 << bits) + edges.shape[0] * (edges.shape[1] + 1) + 1
    r = np.random.default_rng(2)
    ws = [r.normal(0, 0.1, width) for _ in range(2)]
    for halves in (None, [0, 1]):
        models = ws[:1] if halves is None else ws
        got = pu._summed(features, pu._Vector(models, edges, bits, halves))
        expected = []
        for k, w in enumerate(models):
            total = 0
            for ids, stats, at, found in parts:
                for d in range(len(ids)):
                    if halves is None or pu._half(ids[d : d + 1])[0] == k:
                        total = total + pu._moments(pu._csr(stats[d : d + 1], np.array([0, at[d + 1] - at[d]]), found[at[d] : at[d + 1]], edges, bits), w)
            expected.append(total)
        assert np.allclose(got, np.concatenate(expected)) and sum(e[0] for e in expected) == 122
    cuts = [np.array([-0.1, 0.0, 0.2]), np.array([0.0])]
    above = pu._summed(features, pu._Vector(ws, edges, bits, [0, 1], cuts))
    assert len(above) == 6 and above[0] + above[4] == 122 and above[1] >= above[2] >= above[3]


def test_prose_fixture_is_deterministic():
    assert prose(30, 1) == prose(30, 1)
