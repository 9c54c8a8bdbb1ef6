from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from quillgraph.llm.stats import NAMES, column_stats
from quillgraph.llm.tokens import VOCABULARY, column_counts, encoding, tokenizer
from quillgraph.llm.words import grams, slices, words

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab \n\té🙂.|A1　'"), max_size=40)), max_size=8)


def split(text):
    return re.findall(r"[^\t-\r ]+", text or "")


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([1, 16, 1 << 18]))
def test_words_and_grams(texts, limit):
    found, hashes = [], {}
    for part in slices(pa.array(texts, pa.string()), limit):
        w = words(part)
        for d in range(part.hi - part.lo):
            own = [part.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.first[d], w.first[d + 1])]
            found.append(own)
            for k, s in zip(range(w.first[d], w.first[d + 1]), own, strict=True):
                assert hashes.setdefault(s, w.hash[k]) == w.hash[k]
        at, h = grams(w, 3)
        doc = w.doc()
        for k, x in zip(at, h, strict=True):
            s = tuple(found[part.lo + doc[k]][k - w.first[doc[k]] :][:3])
            assert len(s) == 3 and hashes.setdefault(s, x) == x
    assert found == [split(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([1, 1 << 18]))
def test_tokens_are_those_of_the_library(texts, limit):
    enc, t = encoding(), tokenizer(VOCABULARY)
    expected = [enc.encode_ordinary(x or "") for x in texts]
    assert column_counts(pa.array(texts, pa.string())).tolist() == [len(x) for x in expected]
    got = []
    for part in slices(pa.array(texts, pa.string()), limit):
        ids, ends = t.encode(part)
        got += [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert got == expected


def test_statistics_do_not_depend_on_neighbours():
    texts = ["Good plain text, as it is.", None, "", "|| ## $$ !!", "a a a a", "é\né\né", "x" * 50]
    alone = np.concatenate([column_stats(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(column_stats(pa.array(texts, pa.string())), alone)
    assert not alone[1].any() and not alone[2].any()
    at = dict(zip(NAMES, range(len(NAMES)), strict=True))
    assert alone[4, at["repeat_next_ratio"]] == 0.75 and abs(alone[5, at["repeat_line_ratio"]] - 2 / 3) < 1e-9 and alone[6, at["long_word_ratio"]] == 1


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_thue_morse_words_keep_their_ids():
    """They collide under any polynomial hash modulo 2**64."""
    enc, t = encoding(), tokenizer(VOCABULARY)
    for n in (512, 1024, 2048, 4096):
        texts = [f"x {w} y" for w in thue_morse(n)]
        part = next(slices(pa.array(texts)))
        assert len(set(words(part).hash.tolist())) == 4
        ids, ends = t.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [enc.encode_ordinary(x) for x in texts]
        assert column_counts(pa.array(texts)).tolist() == [len(enc.encode_ordinary(x)) for x in texts]


def test_units_of_one_hash_are_told_apart(monkeypatch):
    from quillgraph.llm import tokens

    monkeypatch.setattr(tokens, "span_hash", lambda data, start, end: np.full(len(start), 7, np.uint64))
    texts = ["one two", "three  one\n", "two two", "", "owt"]
    ids, ends = tokenizer(VOCABULARY).encode(next(slices(pa.array(texts))))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [encoding().encode_ordinary(x) for x in texts]
