from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quillgraph.llm import bpe_tree as bt
from quillgraph.llm.tokens import encoding

from .fixtures import awkward, frame, prose

ENC = encoding()
SIGNS = st.text(st.sampled_from("aAbe éß1 2'\t\n\r.,-!s日🙂  "), max_size=300)


@settings(max_examples=300, deadline=None)
@given(SIGNS, SIGNS)
def test_a_join_is_the_encoding_of_the_whole(left, right):
    assert bt.joined(left, ENC.encode_ordinary(left), right, ENC.encode_ordinary(right), ENC) == ENC.encode_ordinary(left + right)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=600), st.sampled_from([8, 17, 64]))
def test_halving_is_exact(text, leaf):
    text = text.encode("utf-8", "replace").decode()
    assert bt.encode_long(text, ENC, leaf) == ENC.encode_ordinary(text)


@pytest.mark.parametrize("alphabet", ["ab", "a", "ACGT", "0123456789", "=-", " ", "é日", "a b"])
def test_long_unsplit_text(alphabet):
    r = random.Random(3)
    text = "".join(r.choice(alphabet) for _ in range(12_000))
    assert bt.encode_long(text, ENC, 256) == ENC.encode_ordinary(text)


@pytest.mark.parametrize("long_document", [1 << 16, 500])
def test_encode_and_decode_every_row(spark, long_document):
    rows = awkward() + [(20, "ab" * 40_000), (20, "ab" * 40_000), (20, "cd" * 30_000), (None, "z" * 70_000)]
    docs = frame(spark, rows)
    out = bt.encode(docs, long_document=long_document, check=True)
    key = lambda x: (x[0] is None, x[0] or 0, repr(x[1]))
    found = out.collect()
    expected = [(i, None if t is None else ENC.encode_ordinary(t)) for i, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in found), key=key) == sorted(expected, key=key)
    assert all(r.exact for r in found if r.ids is not None) and all(r.n_tokens == len(r.ids) for r in found if r.ids is not None)
    assert all(r.n_tokens is None and r.exact is None for r in found if r.ids is None)
    back = [(r.doc_id, r.text) for r in bt.decode(out).collect()]
    assert sorted(back, key=key) == sorted(rows, key=key)


def test_windows_run_on_the_registered_table(spark, sf_dir):
    from pyspark.sql import functions as F

    out = bt.op4(spark, sf_dir)
    joins, mended, wrong, rows = out.agg(F.sum("joins"), F.sum("mended"), F.sum((~F.col("exact")).cast("int")), F.count("*")).first()
    assert joins > 100 and mended > 0.3 * joins and wrong == 0 and rows == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    some = {r.doc_id: r.ids for r in out.where("joins > 2").limit(20).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id").isin(list(some))).collect()}
    assert all(ids == ENC.encode_ordinary(texts[i]) for i, ids in some.items())


def test_levels_join_many_pieces(spark):
    text = "".join(random.Random(4).choice("ab c") for _ in range(40_000))
    out = bt.encode(frame(spark, [(1, text), (2, text + "x")]), long_document=300, leaf=64).collect()
    assert {r.doc_id: r.ids for r in out} == {1: ENC.encode_ordinary(text), 2: ENC.encode_ordinary(text + "x")}
    assert all(r.joins >= 255 for r in out)


def test_empty(spark):
    assert bt.encode(frame(spark, [])).collect() == []
    assert bt.decode(bt.encode(frame(spark, []))).collect() == []


def test_unknown_ids_raise(spark):
    with pytest.raises(Exception, match="outside the vocabulary"):
        bt.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>")).collect()
