from __future__ import annotations

import numpy as np
import pytest
from quillgraph.llm import knn_join as kj


def brute(rows, k):
    data = {}
    sizes = [len(v) for i, v in rows if i is not None and v is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    size = max(sorted(set(sizes)), key=sizes.count) if sizes else 0
    for i, v in rows:
        if i is not None and v is not None and len(v) == size and size and all(x is not None and np.isfinite(x) for x in v):
            data[i] = min(data.get(i, v), v)
    out = {}
    for i, v in data.items():
        d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in data.items() if j != i)[:k]
        out[i] = [(j, x) for x, j in d]
    return out


def check(spark, rows, k, cell_rows, every=1):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cell int, bucket int, v string, d double")
    got = {}
    for r in sorted(kj.nearest(df, k, cell_rows, every).collect()):
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbor_id, r.distance))
    expected = {i: n for i, n in brute([r[:2] for r in rows], k).items() if i % every == 0}
    assert set(got) == {i for i, n in expected.items() if n}
    for i, near in got.items():
        near.sort()
        assert [x[0] for x in near] == list(range(1, len(near) + 1))
        assert [x[1] for x in near] == [j for j, _ in expected[i]]
        assert np.allclose([x[2] for x in near], [d for _, d in expected[i]])


def row(i, v):
    return (i, v, 1, 2, 3, "v", 0.5)


@pytest.mark.parametrize(("cell_rows", "every", "group"), [(20, 1, 1 << 16), (1000, 1, 1 << 16), (None, 1, 10), (None, 7, 4), (5, 3, 1)])
def test_equals_brute_force(spark, monkeypatch, cell_rows, every, group):
    monkeypatch.setattr(kj, "GROUP", group)
    r = np.random.default_rng(1)
    centre = r.normal(size=(6, 5)) * 8
    rows = [row(i, (centre[i % 6] + r.normal(size=5)).tolist()) for i in range(240)]
    check(spark, rows, 7, cell_rows, every)


def test_ties_repeats_and_unusable_rows(spark):
    r = np.random.default_rng(2)
    grid = [row(i, [float(i % 4), float(i // 4 % 4)]) for i in range(32)]  # every point twice: many ties
    odd = [row(None, [1.0, 1.0]), row(50, None), row(51, []), row(52, [float("nan"), 0.0]), row(53, [1.0]), row(54, [None, 1.0]), row(55, [float("inf"), 0.0]), row(3, [3.0, 0.0]), row(3, [2.5, 0.5])]
    check(spark, grid + odd + [row(60 + i, r.normal(size=2).tolist()) for i in range(20)], 5, 8)


def test_fewer_than_k_and_empty(spark):
    check(spark, [row(1, [0.0]), row(2, [1.0]), row(3, [3.0])], 10, 2)
    check(spark, [row(1, [0.0])], 3, 2)
    assert kj.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_bounds_spare_copies(spark, monkeypatch):
    """Far clusters: a group gets the data of its own cluster, not all."""
    r = np.random.default_rng(4)
    rows = [row(i, (np.eye(3)[i % 3] * 1000 + r.normal(size=3)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cell int, bucket int, v string, d double")
    copies = spark.sparkContext.accumulator(0)
    real = kj.packed_batch

    def counted(found):
        copies.add(sum(int(np.frombuffer(b, np.int64, 1)[0]) for _, kind, b in found if kind == 1))
        return real(found)

    monkeypatch.setattr(kj, "packed_batch", counted)
    kj.nearest(df, 5).collect()
    groups = 5  # about the root of 18 cells
    assert 300 <= copies.value < 300 * groups * 0.6


def test_the_registered_query_crosses_cells_and_groups(spark, sf_dir, monkeypatch):
    copies = spark.sparkContext.accumulator(0)
    real = kj.packed_batch

    def counted(found):
        copies.add(sum(int(np.frombuffer(b, np.int64, 1)[0]) for _, kind, b in found if kind == 1))
        return real(found)

    monkeypatch.setattr(kj, "packed_batch", counted)
    folder = sf_dir.replace("0.001", "0.01")
    out = kj.op10(spark, folder).collect()
    data = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    assert len(out) == kj.K * sum(i % kj.EVERY == 0 for i in data) and copies.value > len(data)
    for i in {r.vec_id for r in out}:
        best = sorted((round(float(np.sqrt(((data[i] - x) ** 2).sum())), 6), j) for j, x in data.items() if j != i)[: kj.K]
        assert [(r.distance, r.neighbor_id) for r in sorted(out, key=lambda r: r.rank) if r.vec_id == i] == best
