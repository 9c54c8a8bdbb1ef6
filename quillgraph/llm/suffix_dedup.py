"""Operator 5: repeated passages across documents, by a blockwise suffix array over a difference cover.

Suffixes start at words; the alphabet is the word hash. What deduplication asks of a suffix array is which suffixes share
their first L = ``min_words`` words, so the array is built to that depth, and only where it can hold a repeat:

1. Cover sample. Positions p with p mod 31 in the perfect difference set {0, 1, 3, 8, 12, 18} are the sample: for any two
   positions i and j some shift d < 31 brings both into it. So of every repeat of L words, at any two places, one
   sample suffix pair shares L - 30 words. Sample suffixes are sorted by that prefix, one bucket at a time (a bucket is
   a range of the prefix hash, a partition of its own); their classes are the sample's ranks.
2. Only suffixes within reach of a sample suffix whose rank is tied across documents can repeat. All of those, whatever
   their residue, are sorted to depth L, again a bucket at a time; tied runs are the repeats.

So memory follows the bucket, never the text, and the exchanges hold a fifth of all suffixes, then the repeats alone.
The order within the array is that of hashes, not of letters: deduplication reads ties only. Passages are told apart by
112 bits, 48 that sort them and 64 of another hash that splits their ties, so that none is cut for a chance collision,
at any size (at 10**14 windows one is expected in some 10**6 corpora).

A passage is redundant in a document if it also occurs in a document of smaller doc_id: the first document keeps it.
Repeats inside one document alone are left.

Edge cases: null and empty texts and texts of fewer than ``min_words`` words hold no passage; rows with a null doc_id are
left out of the search and kept by the cut; rows that repeat a doc_id are one document; an empty table gives no rows;
other columns pass through the cut unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import PACKED, Packer, buckets, exchanged, gathered, join48, kept, place, release, repeated, split48, texts, tidy, unpacked
from .words import gram_at, mix, slices, words

MIN_WORDS = 50
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _sample(depth: int, parts: int):
    """The cover sample's suffixes: document, place, and the hash of their first ``depth`` words, by that hash."""

    def each(batches):
        out = Packer(parts, "i8 u4 u2 u4")
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for part in slices(batch.column("text")):
                w = words(part)
                doc = w.doc()
                place_in = np.arange(len(doc)) - w.first[doc]
                at = np.flatnonzero(_IN_COVER[place_in % PERIOD] & (np.arange(len(doc)) + depth <= w.first[doc + 1]))
                key = gram_at(w.hash, at, depth)
                yield from out.add(place(key, parts), ids[part.lo + doc[at]], *split48(key), place_in[at])
        yield from out.flush()

    return each


def _tied(parts: int):
    """Sorts a bucket of sample suffixes; those tied with one of another document go to their documents."""

    def each(batches):
        doc, low, high, at = unpacked(gathered(batches).get(0, []), "i8 u4 u2 u4")
        key, doc, at = repeated(join48(low, high), doc, at)
        if not len(key):
            return
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        mixed = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        keep = np.repeat(mixed, np.diff(np.append(start, len(key))))
        out = Packer(parts, "i8 u4")
        yield from out.add(place(doc[keep], parts), doc[keep], at[keep])
        yield from out.flush()

    return each


def _places(batches):
    """A document's tied sample suffixes, as one row."""
    doc, at = unpacked(gathered(batches).get(0, []), "i8 u4")
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    ends = np.append(new[1:], len(doc))
    for lo in range(0, len(new), 5000):
        some = range(lo, min(lo + 5000, len(new)))
        yield pa.RecordBatch.from_arrays([pa.array(doc[new[some]]), pa.array([at[new[k] : ends[k]].tobytes() for k in some], pa.binary())], ["doc_id", "places"])


def _suffixes(length: int, parts: int):
    """Of each document, the suffixes within reach of a tied sample suffix, with the hash of their first words."""

    def each(batches):
        out = Packer(parts, "i8 u4 u2 u4 u8")
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tied = batch.column("places")
            for part in slices(batch.column("text")):
                w = words(part)
                reach = np.zeros(len(w.hash) + 1, np.int64)
                for k in range(part.hi - part.lo):
                    p = np.frombuffer(tied[part.lo + k].as_buffer(), np.uint32).astype(np.int64)
                    p = p[p < w.first[k + 1] - w.first[k]]
                    np.add.at(reach, w.first[k] + np.maximum(p - PERIOD + 1, 0), 1)
                    np.add.at(reach, w.first[k] + p + 1, -1)
                doc = w.doc()
                i = np.flatnonzero((np.cumsum(reach[:-1]) > 0) & (np.arange(len(doc)) + length <= w.first[doc + 1]))
                key = gram_at(w.hash, i, length)
                check = gram_at(mix(w.hash), i, length)
                yield from out.add(place(key, parts), ids[part.lo + doc[i]], *split48(key), i - w.first[doc[i]], check)
        yield from out.flush()

    return each


def _blocks(parts: int):
    """Sorts a bucket of suffixes to full depth; of each tied run, those outside its first document go to their own."""

    def each(batches):
        doc, low, high, at, check = unpacked(gathered(batches).get(0, []), "i8 u4 u2 u4 u8")
        key, doc, at, check = repeated(join48(low, high), doc, at, check)
        if not len(key):
            return
        begin = np.concatenate(([True], key[1:] != key[:-1]))
        inner = np.concatenate(([False], check[1:] != check[:-1])) & ~begin
        if inner.any():  # passages that fall together in the first 48 bits
            order = np.lexsort((check, key))
            key, doc, at, check = key[order], doc[order], at[order], check[order]
            begin = np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])))
        start = np.flatnonzero(begin)
        first = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(key))))
        keep = doc != first
        out = Packer(parts, "i8 u4 i8")
        yield from out.add(place(doc[keep], parts), doc[keep], at[keep], first[keep])
        yield from out.flush()

    return each


def _spans(length: int):
    """Runs of redundant windows of one document and one first document, joined where they touch."""

    def each(batches):
        doc, at, first = unpacked(gathered(batches).get(0, []), "i8 u4 i8")
        if not len(doc):
            return
        at = at.astype(np.int64)
        order = np.lexsort((at, first, doc))
        doc, at, first = doc[order], at[order], first[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (at[1:] > at[:-1] + length)
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(doc)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[start]), pa.array(first[start]), pa.array(at[start]), pa.array(at[last] + length)], ["doc_id", "first_doc", "start_word", "end_word"])

    return each


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, first_doc, start_word, end_word): words start..end-1 of doc_id are made of windows of ``min_words`` words
    that first_doc, the least doc_id with them, has too."""
    if min_words < PERIOD:
        raise ValueError(f"min_words must be at least {PERIOD}, the period of the difference cover")
    parts = buckets(docs.sparkSession)
    sample = exchanged(texts(docs).mapInArrow(tidy(_sample(min_words - PERIOD + 1, parts)), PACKED), parts)
    tied = exchanged(sample.mapInArrow(tidy(_tied(parts)), PACKED), parts)
    places = kept(tied.mapInArrow(tidy(_places), "doc_id long, places binary"))
    near = texts(docs).join(places.hint("shuffle_hash"), "doc_id")
    block = exchanged(near.mapInArrow(tidy(_suffixes(min_words, parts)), PACKED), parts)
    runs = exchanged(block.mapInArrow(tidy(_blocks(parts)), PACKED), parts)
    return runs.mapInArrow(tidy(_spans(min_words)), "doc_id long, first_doc long, start_word long, end_word long")


def cut(text: str | None, spans: list[tuple[int, int]] | None) -> str | None:
    """text without the given runs of words and the white space after each."""
    if not text or not spans:
        return text
    raw = text.encode()
    part = next(slices(pa.array([raw], pa.binary())))
    w = words(part)
    gone = np.zeros(len(w.start) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[min(b, len(w.start))] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    out, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(raw[at : w.start[a]])
        at = int(w.start[b]) if b < len(w.start) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode()


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, in their own columns, with redundant passages cut from ``text`` (and ``n_chars``, if there is one, set to the
    new length). A document that loses all its words goes; all others stay."""
    spans = repeated_spans(docs, min_words).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("__quill_spans"))
    spans = spans.withColumnRenamed("doc_id", "__quill_id")

    @F.arrow_udf("string")
    def trim(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = pa.array([cut(text[k].as_py(), [(x["start_word"], x["end_word"]) for x in s] if s else None) for k, s in enumerate(spans.to_pylist())], pa.string())
        release()
        return out

    joined = docs.join(spans, docs["doc_id"].cast("long") == spans["__quill_id"], "left")
    touched = F.col("__quill_spans").isNotNull()
    new = F.when(touched, trim(docs["text"], F.col("__quill_spans"))).otherwise(docs["text"])
    out = joined.select(*[docs[c] for c in docs.columns if c != "text"], new.alias("text"), touched.alias("__quill_cut"))
    out = out.where(~F.col("__quill_cut") | F.col("text").rlike("[^\\t-\\r ]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__quill_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH w AS (SELECT DISTINCT doc_id, regexp_extract_all(text, '[^\\t-\\r ]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(ws[i + 1:i + 50], ' ')) AS first_doc FROM g),
r AS (SELECT doc_id, first_doc, i, lag(i) OVER (PARTITION BY doc_id, first_doc ORDER BY i) AS before FROM f WHERE first_doc < doc_id),
s AS (SELECT doc_id, first_doc, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, first_doc ORDER BY i) AS part FROM r)
SELECT doc_id, first_doc, min(i) AS start_word, max(i) + 50 AS end_word FROM s GROUP BY doc_id, first_doc, part
"""
