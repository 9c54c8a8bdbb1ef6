"""Vectorised words and word n-grams over Arrow string buffers.

Texts reach Python as Arrow batches; everything here works on their UTF-8 bytes with numpy, a slice of documents
at a time, so memory follows ``SLICE_BYTES`` (or the longest single text), never the batch or the partition.

A *word* is a maximal run of bytes other than the six ASCII white-space bytes (9-13 and 32). SQL spells it
``regexp_extract_all(text, '[^\\t-\\r ]+')``. A null text has no words, as an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 3 << 18
MAX_ROWS = 1 << 15
_LONG = 512  # bytes; longer spans are hashed one by one
_GRAM = 0xD6E8FEB86659FD93  # odd, so invertible modulo 2**64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
INK = ~SPACE
PLAIN = np.zeros(256, bool)  # what is left of a word when case and punctuation don't matter: ASCII letters, digits, all else from 128 on
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown per process."""
    table = _tables.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, SLICE_BYTES + 2), base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _tables[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice(NamedTuple):
    """Some documents of a batch: rows lo..hi, their bytes, and where each begins (one more offset at the end)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's documents in slices of at most ``limit`` bytes, or one document where that is longer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1), lo + MAX_ROWS)
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


class Words(NamedTuple):
    """Words of a slice: byte bounds, 64-bit hashes, and for each document its first word (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        """Each word's document, as an index into the slice."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as one number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), "<u8", buffer=np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def only(value: np.ndarray, left: np.ndarray) -> np.ndarray:
    """value without the bytes from the left-th on, where fewer than eight are left."""
    short = np.flatnonzero(left < 8)
    value[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
    return value


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit content hashes of byte spans, whatever their place in ``data``.

    Eight bytes at a time go through a bijection that spreads every bit, so spans of up to eight bytes and one length never
    collide, and longer ones by chance alone, whatever their structure (a polynomial modulo 2**64 would collide for
    Thue-Morse words). Who merges by this hash and must not be wrong compares bytes too."""
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) * np.uint64(_GRAM))
    long = size > _LONG
    for k in np.flatnonzero(long).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    rows = np.flatnonzero(~long)
    chunk, at, left = eights(data), start[rows].astype(np.int64), size[rows]
    while len(rows):
        out[rows] = mix(out[rows] ^ only(chunk[at], left))
        more = np.flatnonzero(left > 8)
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


def bounds(data: np.ndarray, offsets: np.ndarray, inked: np.ndarray = INK) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the words of a slice, none reaching over a document's end."""
    ink = np.zeros(len(data) + 1, bool)
    ink[:-1] = inked[data]
    change = ink[1:] != ink[:-1]  # at i: a word begins or ends at i + 1
    before = np.flatnonzero(change) + 1
    if ink[0]:
        before = np.concatenate(([0], before))
    start, end = before[0::2], before[1::2]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):
        cuts = cuts[np.concatenate(([True], cuts[1:] != cuts[:-1]))]
        cuts = cuts[ink[cuts] & ink[cuts - 1]]  # words of two documents that touch
    if len(cuts):
        start, end = np.sort(np.concatenate((start, cuts))), np.sort(np.concatenate((end, cuts)))
    return start, end


def words(part: Slice, plain: bool = False) -> Words:
    """``plain``: words are runs of letters and digits, ASCII capitals count as small ones."""
    data = FOLD[part.data] if plain else part.data
    start, end = bounds(data, part.offsets, PLAIN if plain else INK)
    first = np.searchsorted(start, part.offsets)
    return Words(start, end, span_hash(data, start, end), first)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The word index and the hash of every run of n words that lies within one document."""
    size = len(w.hash)
    if size < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    counts = np.diff(w.first)
    last = np.repeat(w.first[1:], counts)
    at = np.flatnonzero(np.arange(size) + n <= last)
    return at, gram_at(w.hash, at, n)


def gram_at(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n values of ``hashes`` that begin at the given places."""
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(_GRAM, len(hashes)), out=prefix[1:])
    inverse = _powers(pow(_GRAM, -1, 1 << 64), len(hashes) + 1)
    return mix((prefix[at + n] - prefix[at]) * inverse[at])
