"""Operator 4: BPE encoding and decoding of texts of any length, by tree concatenation.

Every text is halved until pieces are short, wherever the middle falls, be it inside a word; pieces are encoded, and
halves are joined, as a tree. At each join a window around the seam, some tokens of both sides, is encoded again, and
grows until its first token is the left side's and its last the right side's. Texts of more than ``long_document``
characters are spread: their pieces are encoded as rows of their own, and joined ``FAN_IN`` at a time in as many levels
as the longest text needs, each level in parallel. That is exact by two facts. (1) A sequence is the encoding of its bytes if every two neighbours are, so where a window begins and ends with
tokens of both sides, all pairs are right. (2) The pattern splits the window as it splits the text, if the window begins
and ends at an edge that the pattern makes or respects: before white space that follows ink, or three letters (digits,
other signs) into a run of them.

Edge cases: a null text gives null ids, an empty one no ids; rows that repeat are encoded alike; other columns are not
looked at; invalid surrogates cannot occur in Spark strings. Decoding unknown ids raises.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import buckets, tidy
from .tokens import SLICE, VOCABULARY, encoding, tokenizer, vocabulary_bytes
from .words import slices

LEAF = 1024  # characters of a piece that is encoded at once
LONG_DOCUMENT = 1 << 16  # characters; longer documents are spread over tasks
FAN_IN = 8  # pieces of a long document that one task joins
_SPACE = " \t\n\r\f\v"


def _kind(c: str) -> str:
    if c.isspace():
        return "S"
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "O"


def safe(text: str, i: int) -> bool:
    """Whether the pattern's pieces on both sides of i don't depend on the other side, but for a run that i divides."""
    if i <= 0 or i >= len(text):
        return True
    if text[i] in _SPACE:
        return not text[i - 1].isspace() and _kind(text[i - 1]) != "S"
    if text[i] == "'" or i < 3:
        return False
    k = _kind(text[i])
    return k != "S" and all(_kind(c) == k and c != "'" for c in text[i - 3 : i])


def joined(left: str, a: list[int], right: str, b: list[int], enc, seen: list[int] | None = None) -> list[int]:
    """The encoding of left + right, from those of both. ``seen`` counts joins, and those whose window came out anew."""
    if not a or not b:
        return list(a) + list(b)
    text = left + right
    size = 4
    while True:
        size = min(size, max(len(a), len(b)))
        na, nb = min(size, len(a)), min(size, len(b))
        head = enc.decode_bytes(a[len(a) - na :])
        tail = enc.decode_bytes(b[:nb])
        try:
            window = (head + tail).decode()
            cut, end = len(left) - len(head.decode()), len(left) + len(tail.decode())
        except UnicodeDecodeError:  # a token that is part of a character
            window = None
        everything = na == len(a) and nb == len(b)
        r = None
        if window is not None:
            r = enc.encode_ordinary(window)
            fine_left = na == len(a) or (r[0] == a[len(a) - na] and safe(text, cut))
            fine_right = nb == len(b) or (r[-1] == b[nb - 1] and safe(text, end))
            if not (everything or (fine_left and fine_right and len(r) > 1)):
                r = None
        elif everything:
            r = enc.encode_ordinary(text)
        if r is not None:
            if seen is not None:
                seen[0] += 1
                seen[1] += r != list(a[len(a) - na :]) + list(b[:nb])
            return list(a[: len(a) - na]) + r + list(b[nb:])
        size *= 2


def halves(text: str, leaf: int) -> list[str]:
    """The leaves of the tree over text, from left to right: halves of halves, of at most ``leaf`` characters."""
    if len(text) <= leaf:
        return [text]
    i = len(text) // 2
    return halves(text[:i], leaf) + halves(text[i:], leaf)


def tree(parts: list[tuple[str, list[int]]], enc, seen: list[int] | None = None) -> tuple[str, list[int]]:
    """Joins the halves of the list, each joined before."""
    if len(parts) == 1:
        return parts[0]
    i = len(parts) // 2
    left, right = tree(parts[:i], enc, seen), tree(parts[i:], enc, seen)
    return left[0] + right[0], joined(*left, *right, enc, seen)


def encode_long(text: str, enc, leaf: int = LEAF) -> list[int]:
    """The encoding of text, by halves."""
    return tree([(t, enc.encode_ordinary(t)) for t in halves(text, leaf)], enc)[1]


def _trees(texts: list[str], path: str, leaf: int) -> list[tuple[list[int], int, int]]:
    """(ids, joins, joins whose window came out anew) of each text. The leaves of all texts are encoded in one call."""
    t, enc = tokenizer(path), encoding(path)
    cut = [halves(x, leaf) for x in texts]
    own: list[list[int]] = []
    for part in slices(pa.array([p for c in cut for p in c], pa.large_string()), SLICE):
        ids, ends = t.encode(part)
        flat, ends = ids.tolist(), ends.tolist()
        own += [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    out, at = [], 0
    for c in cut:
        seen = [0, 0]
        out.append((tree(list(zip(c, own[at : at + len(c)], strict=True)), enc, seen)[1], *seen))
        at += len(c)
    return out


def encode(docs: DataFrame, path: str = VOCABULARY, long_document: int = LONG_DOCUMENT, check: bool = False, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids, joins, mended) of every row: how many joins its tree has, and at how many of them the window
    came out other than as the two sides had it. With ``check`` also ``exact``: whether decoding gives the text again."""
    schema = "doc_id long, n_tokens long, ids array<int>, joins long, mended long" + ", exact boolean" * check
    names = ["doc_id", "n_tokens", "ids", "joins", "mended"] + ["exact"] * check
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    longest = base.agg(F.max(F.length("text"))).first()[0] or 0

    def rows(ids: list, times: list[int], found: list, texts: list) -> pa.RecordBatch:
        null = [f is None for f in found]
        columns = [pa.array(ids, pa.int64()), pa.array([None if f is None else len(f[0]) for f in found], pa.int64()), pa.array([None if f is None else f[0] for f in found], pa.list_(pa.int32()))]
        columns += [pa.array([None if f is None else f[k] for f in found], pa.int64()) for k in (1, 2)]
        if check:
            enc = encoding(path)
            columns.append(pa.array([None if n else enc.decode_bytes(f[0]) == x.encode() for n, f, x in zip(null, found, texts, strict=True)], pa.bool_()))
        batch = pa.RecordBatch.from_arrays(columns, names)
        return batch if set(times) <= {1} else batch.take(pa.array(np.repeat(np.arange(len(ids)), times)))

    def short(batches):
        for batch in batches:
            texts = batch.column("text")
            for part in slices(texts, SLICE):
                own = texts.slice(part.lo, part.hi - part.lo).to_pylist()
                known = iter(_trees([x for x in own if x is not None], path, leaf))
                found = [None if x is None else next(known) for x in own]
                yield rows(batch.column("doc_id").slice(part.lo, part.hi - part.lo).to_pylist(), [1], found, own)

    few = base.where(F.coalesce(F.length("text"), F.lit(0)) <= long_document).mapInArrow(tidy(short), schema)
    if longest <= long_document:
        return few

    kinds = "doc_id long, row string, times long, piece long, text string, ids array<int>, joins long, mended long"
    fields = [k.split()[0] for k in kinds.split(", ")]

    def split(batches):
        for batch in batches:
            for i, row, times, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "times", "text")), strict=True):
                parts = halves(text, long_document)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(parts), pa.int64()), pa.array([row] * len(parts), pa.string()), pa.array([times] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], fields[:5])

    def encoded(batches):
        for batch in batches:
            found = _trees(batch.column("text").to_pylist(), path, leaf)
            more = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields[:5]), *more], fields)

    def merge(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["piece"])
        seen = [sum(r["joins"] for r in parts), sum(r["mended"] for r in parts)]
        text, ids = tree([(r["text"], r["ids"]) for r in parts], encoding(path), seen)
        one = parts[0] | {"piece": parts[0]["piece"] // FAN_IN, "text": text, "ids": ids, "joins": seen[0], "mended": seen[1]}
        return pa.Table.from_pylist([one], pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("times", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("joins", pa.int64()), ("mended", pa.int64())]))

    def finished(batches):
        for batch in batches:
            found = list(zip(*(batch.column(c).to_pylist() for c in ("ids", "joins", "mended")), strict=True))
            yield rows(batch.column("doc_id").to_pylist(), batch.column("times").to_pylist(), found, batch.column("text").to_pylist())

    # Rows that repeat wholly are one row with a number; the digest keeps apart different texts under one id.
    many = base.where(F.length("text") > long_document).groupBy("doc_id", "text").agg(F.count("*").alias("times")).select("doc_id", F.sha2("text", 256).alias("row"), "times", "text")
    many = many.mapInArrow(tidy(split), ", ".join(kinds.split(", ")[:5])).repartition(buckets(docs.sparkSession), "doc_id", "row", "piece").mapInArrow(tidy(encoded), kinds)
    pieces = 2 * -(-longest // long_document)  # at most: halves may be a little over half as long as allowed
    while pieces > 1:
        many = many.groupBy("doc_id", "row", F.floor(F.col("piece") / FAN_IN)).applyInArrow(merge, kinds)
        pieces = -(-pieces // FAN_IN)
    return few.unionByName(many.mapInArrow(tidy(finished), schema))


def decoded(ids: np.ndarray, ends: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a run of id sequences, and each one's bounds."""
    data, bounds = table
    if len(ids) and (ids.min() < 0 or ids.max() >= len(bounds) - 1):
        raise ValueError("an id is outside the vocabulary")
    size = (bounds[1:] - bounds[:-1])[ids]
    total = np.concatenate(([0], np.cumsum(size)))
    out = data[np.repeat(bounds[ids] - total[:-1], size) + np.arange(total[-1])]
    return out, total[ends]


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids). Null ids give a null text."""

    def each(batches):
        table = vocabulary_bytes(path)
        for batch in batches:
            lists = batch.column("ids")
            null = np.asarray(lists.is_null())
            lists = lists.fill_null([]) if null.any() else lists
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
            data, at = decoded(lists.flatten().to_numpy(zero_copy_only=False), ends, table)
            text = [None if null[k] else data[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace") for k in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(each), "doc_id long, text string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), check=True)
