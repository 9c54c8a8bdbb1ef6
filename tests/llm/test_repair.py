from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from quillgraph.llm import repair
from quillgraph.llm.tokens import encoding

from .fixtures import awkward, frame, prose

ENC = encoding()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=12))
def test_grammar_round_trip(documents):
    ids = np.array([x for d in documents for x in d], np.int32)
    ends = np.concatenate(([0], np.cumsum([len(d) for d in documents]))).astype(np.int64)
    rules, expansion, codes, code_ends = repair.grammar(ids, ends, 6, least=3)
    assert repair.expand(codes, rules, 6).tolist() == ids.tolist()
    for k, d in enumerate(documents):  # no code reaches over a document's end
        assert repair.expand(codes[code_ends[k] : code_ends[k + 1]], rules, 6).tolist() == d
    for r in range(len(rules)):
        assert expansion[r] == len(repair.expand(np.array([6 + r]), rules, 6))


def apart(documents):
    """How often each pair occurs without overlapping itself."""
    count = {}
    for d in documents:
        taken = {}
        for k, p in enumerate(zip(d, d[1:], strict=False)):
            if taken.get(p, -2) < k - 1 or p[0] != p[1]:
                taken[p] = k
                count[p] = count.get(p, 0) + 1
    return count


def plain_repair(documents, first):
    """Re-Pair as it is told: the most frequent pair, again and again, by scanning everything."""
    documents, rules = [list(d) for d in documents], 0
    while True:
        count = apart(documents)
        best = max(count, key=lambda p: (count[p], p), default=None)
        if best is None or count[best] < 2:
            return sum(map(len, documents)) + 2 * rules
        for d in documents:
            k = 0
            while k < len(d) - 1:
                if (d[k], d[k + 1]) == best:
                    d[k : k + 2] = [first + rules]
                k += 1
        rules += 1


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=80), max_size=8), st.sampled_from([(0.3, 0.1), (1.0, 0.0), (0.0, 1.0)]))
def test_no_repeated_pair_is_left(documents, order):
    ids = np.array([x for d in documents for x in d], np.int32)
    ends = np.concatenate(([0], np.cumsum([len(d) for d in documents]))).astype(np.int64)
    rules, _, codes, code_ends = repair.grammar(ids, ends, 5, 2, *order)
    left = apart([codes[a:b].tolist() for a, b in zip(code_ends[:-1], code_ends[1:], strict=True)])
    assert max(left.values(), default=0) < 2
    assert repair.expand(codes, rules, 5).tolist() == ids.tolist()
    assert len({tuple(r) for r in rules.tolist()}) == len(rules)


def test_sizes_are_those_of_plain_repair():
    total = plain = strict = 0
    for seed in range(12):
        r = np.random.default_rng(seed)
        words = [r.integers(0, 12, r.integers(2, 7)).tolist() for _ in range(15)]
        documents = [[x for w in r.integers(0, 15, 30) for x in words[w]] for _ in range(6)]
        ids, ends = np.array([x for d in documents for x in d], np.int32), np.concatenate(([0], np.cumsum([len(d) for d in documents])))
        for order, add in (((1.0, 0.0), 0), ((repair.SHARE, repair.PORTION), 1)):
            rules, _, codes, _ = repair.grammar(ids, ends, 12, 2, *order)
            strict, total = strict + (1 - add) * (len(codes) + 2 * len(rules)), total + add * (len(codes) + 2 * len(rules))
        plain += plain_repair(documents, 12)
    assert strict < 1.01 * plain and total < 1.1 * plain  # the default order costs more on texts this small than on shards


def test_packed_codes():
    codes = np.array([0, 255, 256, 65_535, 65_536, (1 << 24) - 1], np.uint32)
    assert repair.unpacked(repair.packed(codes, 3), 3).tolist() == codes.tolist()
    assert repair.unpacked(repair.packed(codes[:4], 2), 2).tolist() == codes[:4].tolist()


def test_shards_round_trip_and_random_access(spark):
    rows = awkward() + [(100 + i, prose(300, i, words=50)) for i in range(60)]
    shards = repair.shards(frame(spark, rows), least=4)
    key = lambda x: (x[0] is None, x[0] or 0, repr(x[1]))
    expected = [(i, None if t is None else ENC.encode_ordinary(t)) for i, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in repair.decode(shards).collect()), key=key) == sorted(expected, key=key)
    text = {i: ids for i, ids in expected if i is not None}
    seen = 0
    for shard in shards.collect():
        for k, i in enumerate(shard["doc_ids"]):
            if i is None or i in (4, 14):
                continue
            got = repair.document(shard, k)
            if text[i] is None:
                assert got is None
                continue
            assert got.tolist() == text[i]
            for a, b in ((0, 1), (3, 17), (5, 5), (len(text[i]) - 2, len(text[i]) + 9)):
                assert repair.document(shard, k, max(a, 0), b).tolist() == text[i][max(a, 0) : b]
            seen += 1
    assert seen > 60


def test_it_compresses(spark):
    docs = frame(spark, [(i, prose(2000, i, words=30)) for i in range(40)])
    rows = repair.shards(docs).collect()
    raw = sum(2 * sum(r["n_tokens"]) for r in rows)
    assert sum(len(r["codes"]) + len(r["rules"]) + len(r["expansions"]) for r in rows) < 0.7 * raw


def test_shard_numbers_differ(spark):
    numbers = [r.shard for r in repair.shards(frame(spark, awkward())).collect()]
    assert len(set(numbers)) == len(numbers)


def test_empty(spark):
    assert repair.shards(frame(spark, [])).collect() == []
    assert repair.decode(repair.shards(frame(spark, []))).collect() == []
