from __future__ import annotations

import re

import numpy as np
import pytest
from quillgraph.llm import suffix_dedup as sd

from .fixtures import awkward, frame, prose


def words(text):
    return re.findall(r"[^\t-\r ]+", text or "")


def brute(rows, n=50):
    """The least document of every window, then runs of windows with one first document, joined where they touch."""
    docs = {i: words(t) for i, t in rows if i is not None}
    first = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - n + 1):
            first.setdefault(tuple(docs[i][k : k + n]), i)
    out = set()
    for i, ws in docs.items():
        by = {}
        for k in range(len(ws) - n + 1):
            f = first[tuple(ws[k : k + n])]
            if f < i:
                by.setdefault(f, []).append(k)
        for f, at in by.items():
            start = last = at[0]
            for k in at[1:]:
                if k > last + n:
                    out.add((i, f, start, last + n))
                    start = k
                last = k
            out.add((i, f, start, last + n))
    return out


def planted():
    shared = [prose(51 + 13 * k, 50 + k) for k in range(6)]
    return [(100 + i, "\n".join([prose(17 * i % 90, 200 + i), shared[i % 6], prose(11 * i % 70, 300 + i), shared[(i * i) % 6]])) for i in range(30)]


def result(df):
    rows = [tuple(r) for r in df.select("doc_id", "first_doc", "start_word", "end_word").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("n", [31, 50, 77])
def test_equals_brute_force(spark, n):
    rows = awkward() + planted()
    expected = brute(rows, n)
    assert len(expected) > 20
    assert result(sd.repeated_spans(frame(spark, rows), n)) == expected


def test_least_length_and_one_less(spark):
    p = prose(50, 70)
    rows = [(1, p), (2, "lead " + p + " tail"), (3, "other " + " ".join(p.split()[:49]) + " tail")]
    assert result(sd.repeated_spans(frame(spark, rows))) == {(2, 1, 1, 51)}


def test_repeats_within_one_document_stay(spark):
    p = prose(60, 71)
    assert result(sd.repeated_spans(frame(spark, [(1, p + " and " + p)]))) == set()


def test_cover_brings_any_two_places_together():
    cover = set(sd.COVER)
    for i in range(sd.PERIOD):
        for j in range(sd.PERIOD):
            assert any((i + d) % sd.PERIOD in cover and (j + d) % sd.PERIOD in cover for d in range(sd.PERIOD))


def test_short_windows_are_refused(spark):
    with pytest.raises(ValueError):
        sd.repeated_spans(frame(spark, []), sd.PERIOD - 1)


def test_empty(spark):
    assert sd.repeated_spans(frame(spark, [])).collect() == []
    assert sd.without_repeats(frame(spark, [])).collect() == []


def test_cut_removes_what_was_found_and_nothing_else(spark):
    rows = awkward() + planted()
    docs = frame(spark, rows)
    out = sd.without_repeats(docs)
    assert out.columns == docs.columns
    spans = brute(rows)
    expected = []
    for i, t in rows:
        gone = {k for d, _, a, b in spans if d == i for k in range(a, b)} if i is not None else set()
        left = [w for k, w in enumerate(words(t)) if k not in gone]
        if not gone:
            expected.append((i, t))
        elif left:
            expected.append((i, " ".join(left)))
    got = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
    touched = {d for d, *_ in spans}
    flat = lambda i, t: (i is None, i or 0, " ".join(words(t)) if i in touched else repr(t))
    assert sorted(flat(i, t) for i, t, _ in got) == sorted(flat(i, t) for i, t in expected)
    assert all(n == len(t) for _, t, n in got if t is not None)
    assert sd.repeated_spans(out).collect() == []


def test_passages_that_fall_together_in_the_first_hash_are_told_apart(spark, monkeypatch):
    """With only 4 of the 48 bits left nearly all passages share a key; the second hash must split them."""
    real = sd.split48
    monkeypatch.setattr(sd, "split48", lambda key: real(key & np.uint64(15)))
    rows = [(i, prose(140, 500 + i, words=5000)) for i in range(12)] + [(50 + i, prose(60, 700 + i, words=5000) + " " + prose(80, 600, words=5000)) for i in range(4)]
    got = sorted((r.doc_id, r.first_doc) for r in sd.repeated_spans(frame(spark, rows)).collect())
    assert got == [(51, 50), (52, 50), (53, 50)]
