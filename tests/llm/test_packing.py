from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quillgraph.llm import packing
from quillgraph.llm.tokens import encoding

from .fixtures import awkward, frame, prose


def padding(length, count, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(length, count, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_bounds_are_optimal(histogram, buckets):
    length, count = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)])
    bounds = packing.optimal_bounds(length, count, buckets)
    assert len(bounds) <= buckets and bounds[-1] == length[-1]
    best = min(padding(length, count, [*c, length[-1]]) for k in range(buckets) for c in itertools.combinations(length[:-1].tolist(), min(k, len(length) - 1)))
    assert padding(length, count, bounds) == best


@pytest.mark.parametrize(("buckets", "budget", "step"), [(4, 600, 1), (16, 16_384, 1), (3, 256, 16)])
def test_every_row_has_one_place(spark, buckets, budget, step):
    rows = awkward() + [(100 + i, prose(3 + i * i % 300, i)) for i in range(150)]
    out = packing.pack(frame(spark, rows), buckets, budget, step).collect()
    enc = encoding()
    size = lambda t: len(enc.encode_ordinary(t or ""))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.n_tokens) for r in out), key=key) == sorted(((i, size(t)) for i, t in rows), key=key)
    batches = defaultdict(list)
    for r in out:
        assert r.n_tokens <= r.bound
        batches[(r.bucket, r.bound, r.batch)].append(r)
    assert len({b for b, _, _ in batches}) == len({x for _, x, _ in batches}) <= buckets
    last = defaultdict(int)
    for bucket, _, batch in batches:
        last[bucket] = max(last[bucket], batch)
    for (bucket, bound, batch), members in batches.items():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * max(bound, 1) <= budget
        assert batch == last[bucket] or len(members) == max(1, budget // max(bound, 1))  # all but the last are full


def test_empty(spark):
    assert packing.pack(frame(spark, [])).collect() == []
