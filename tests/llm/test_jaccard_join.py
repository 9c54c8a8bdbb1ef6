from __future__ import annotations

import itertools
import re
import time

import pytest
from quillgraph.llm import jaccard_join as jj

from .fixtures import awkward, frame, prose


def tokens(text, n=3):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    ws = re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) if len(ws) >= n else frozenset([tuple(ws)])


def brute(rows, n=3, threshold=0.5):
    """All pairs, with equal sets reduced to stars and pairs between the least documents of each set."""
    sets = {}
    for i, t in rows:
        if i is not None and tokens(t, n):
            sets.setdefault(i, tokens(t, n))
    lead = {}
    for i in sorted(sets):
        lead.setdefault(sets[i], i)
    out = {(lead[s], i): 1.0 for i, s in sets.items() if lead[s] != i}
    for (s, i), (t, j) in itertools.combinations(sorted(lead.items(), key=lambda x: x[1]), 2):
        x = len(s & t) / len(s | t)
        if x >= threshold:
            out[(i, j)] = x
    return out


def near_copies():
    rows = []
    for k in range(12):
        base = prose(60 + 15 * k, 100 + k).split()
        for c in range(5):
            own = list(base)
            for e in range(c * (k % 5 + 1)):
                own[(7 * e + c) % len(own)] = f"changed{c}{e}"
            rows.append((1000 + 10 * k + c, " ".join(own)))
    return rows


def result(df):
    rows = [(r.doc_a, r.doc_b, r.jaccard) for r in df.collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return {r[:2]: r[2] for r in rows}


@pytest.mark.parametrize(("n", "threshold"), [(3, 0.5), (2, 0.8), (1, 0.35), (3, 1.0)])
def test_equals_brute_force(spark, n, threshold):
    rows = awkward() + near_copies()
    found, expected = result(jj.jaccard_join(frame(spark, rows), n, threshold)), brute(rows, n, threshold)
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in expected)
    assert len(expected) > (10 if threshold < 1 else 2)


def test_many_copies_are_a_star(spark):
    rows = [(i, prose(50, 9)) for i in range(300)] + [(1000, prose(50, 9) + " end")]
    found = result(jj.jaccard_join(frame(spark, rows)))
    assert set(found) == {(0, i) for i in range(1, 300)} | {(0, 1000)}


def brute_classes(rows, n=3, threshold=0.5):
    """(doc_id: (class, links)) by comparing all entries of a document and a set with all others."""
    entries = sorted({(i, tuple(sorted(tokens(t, n)))) for i, t in rows if i is not None and tokens(t, n)})
    sets = [frozenset(s) for _, s in entries]
    links, up = [0] * len(entries), {i: i for i, _ in entries}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(entries)), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            links[a] += 1
            links[b] += 1
            x, y = root(entries[a][0]), root(entries[b][0])
            up[max(x, y)] = min(x, y)
    total = {}
    for (i, _), c in zip(entries, links, strict=True):
        total[i] = total.get(i, 0) + c
    return {i: (root(i), c) for i, c in total.items() if c}


@pytest.mark.parametrize(("block", "threshold"), [(8192, 0.5), (2, 0.5), (3, 0.8)])
def test_classes_equal_brute_force(spark, monkeypatch, block, threshold):
    """Also with blocks so small that groups are solved in many of them."""
    monkeypatch.setattr(jj, "BLOCK", block)
    twice = [(40, prose(70, 31)), (40, prose(70, 32)), (41, prose(70, 31) + " end"), (42, prose(70, 32)), (43, prose(70, 33)), (43, "other words here"), (44, prose(70, 33) + " z")]
    rows = awkward() + near_copies() + twice + [(i, prose(50, 9)) for i in range(2000, 2060)] + [(3000, prose(50, 9) + " end")]
    found = {r.doc_id: (r.class_id, r.n_links) for r in jj.classes(frame(spark, rows), threshold=threshold).collect()}
    assert found == brute_classes(rows, threshold=threshold)
    assert len(found) > 70


def test_classes_over_tasks_equal_brute_force(spark):
    """Copies met by several tasks have several names; tokens that only they have lead nowhere."""
    rows = awkward() + near_copies() + [(i, prose(50, i % 4)) for i in range(2000, 2040)] + [(3000, prose(50, 1) + " end")]
    found = {r.doc_id: (r.class_id, r.n_links) for r in jj.classes(frame(spark, rows).repartition(5)).collect()}
    assert found == brute_classes(rows)


def test_names_differ_within_a_task():
    names, taken = {}, set()
    jj._named([5, 5 + (1 << 32), 6, (1 << 32) - 1, (1 << 33) - 1], names, taken)
    jj._named([5 + (2 << 32)], names, taken)
    assert len(set(names.values())) == len(names) == len(taken) == 6
    assert max(taken) < 1 << 32
    assert names[5] == 5 and names[(1 << 32) - 1] == (1 << 32) - 1


@pytest.mark.parametrize("parts", [12, 1000])
def test_an_entry_takes_few_bytes_however_many_the_buckets(spark, parts):
    """A signature beside each token made 14 bytes of it where buckets are many."""
    rows = [(i, prose(200, i)) for i in range(400)]
    out = jj.texts(frame(spark, rows)).coalesce(1).mapInArrow(jj._spread(3, parts), jj.PACKED)
    sent = sum(len(r.blob) for r in out.where("kind = 0").collect())
    assert sent < 10 * sum(len(tokens(t)) for _, t in rows)


def test_exchanges_leave_no_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    before = files()
    table = jj.settled(spark.range(20_000).selectExpr("id % 1001 AS v").groupBy("v").count())
    left = 100
    while left and {x for x in files() - before if x.startswith("shuffle_")}:  # they go in the background
        time.sleep(0.1)
        left -= 1
    assert left
    assert table.count() == 1001


def test_rows_that_repeat_an_id_leave_the_least(spark):
    rows = [(1, "b c d e f g"), (1, "a c d e f g"), (2, None), (2, None), (3, ""), (3, "zz y x"), (4, "b c d e f g"), (None, "b c d e f g")]
    kept = sorted(((r.doc_id, r.text) for r in jj.one_of_each(frame(spark, rows)).collect()), key=repr)
    assert kept == sorted([(1, "a c d e f g"), (2, None), (3, ""), (None, "b c d e f g")], key=repr)


def test_empty(spark):
    assert jj.classes(frame(spark, [])).collect() == []
    assert jj.jaccard_join(frame(spark, [])).collect() == []
    assert jj.one_of_each(frame(spark, [])).collect() == []


def test_bad_parameters(spark):
    for n, t in ((0, 0.5), (3, 0.0), (3, 1.5)):
        with pytest.raises(ValueError):
            jj.jaccard_join(frame(spark, []), n, t)


def test_components_are_least_members(spark):
    pairs = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 5), (200, 201), (201, 200), (300, 300)]
    found = {r.doc_id: r.group_id for r in jj.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    expected = {i: i - i % 10 for i in range(40)} | {100: 0, 200: 200, 201: 200}
    found.pop(300, None)
    assert found == expected


def test_one_of_each_keeps_all_but_copies(spark):
    rows = awkward() + near_copies()
    docs = frame(spark, rows)
    kept = jj.one_of_each(docs)
    assert kept.columns == docs.columns
    pairs = brute(rows)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    gone = {x for x in up if root(x) != x}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, _ in rows if i is not None} - gone)
    assert ids.count(None) == 2
