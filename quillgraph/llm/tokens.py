"""Exact byte-pair tokenisation by cached units.

The public byte-level pattern never joins what stands before a run of ASCII white space with what follows it. A *unit* is
such a run (maybe empty, at a text's start) with the ink after it; at a text's end a run alone. Encoding unit by unit
gives the encoding of the whole, so the distinct units of some megabytes are encoded once, in one call, and the rest is
numpy. Units are merged by a hash and then compared byte by byte. Texts that hold non-ASCII white space, which the pattern
also looks at across units, are encoded whole. Compared with the library's own ``encode_ordinary`` in the tests.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa

from .shared import TOKENIZERS
from .words import SPACE, Slice, bounds, eights, only, slices, span_hash

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_UNIT = 4096  # bytes; longer units are encoded by parts and joined, see bpe_tree
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
SLICE = 1 << 21  # bytes of text among which distinct units are sought


@functools.cache
def encoding(path: str = VOCABULARY):
    """The tiktoken encoding over a rank file; one a process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("quillgraph", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _same_bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray, like: np.ndarray) -> bool:
    """Whether every unit has the bytes of the unit that ``like`` names for it. Eight bytes at a time, long ones whole."""
    if not np.array_equal(size[like], size):
        return False
    rows = np.flatnonzero(like != np.arange(len(like)))
    a, b, left, chunk = start[rows], start[like[rows]], size[rows], eights(data)
    for k in np.flatnonzero(left > LONG_UNIT).tolist():
        if not np.array_equal(data[a[k] : a[k] + left[k]], data[b[k] : b[k] + left[k]]):
            return False
    some = np.flatnonzero(left <= LONG_UNIT)
    a, b, left = a[some], b[some], left[some]
    while len(a):
        if only(chunk[a] ^ chunk[b], left).any():
            return False
        some = np.flatnonzero(left > 8)
        a, b, left = a[some] + 8, b[some] + 8, left[some] - 8
    return True


class UnitTokenizer:
    """Token ids (or only their numbers) of the documents of a slice."""

    def __init__(self, path: str = VOCABULARY) -> None:
        self.path, self.encoding = path, encoding(path)
        self.width = np.diff(vocabulary_bytes(path)[1])  # bytes of each token

    def whole(self, raw: bytes) -> list[int]:
        return self.encoding.encode_ordinary(raw.decode("utf-8", "replace"))

    def _alone(self, raw: bytes) -> np.ndarray:
        from .bpe_tree import encode_long

        return np.array(encode_long(raw.decode("utf-8", "replace"), self.encoding) if len(raw) > LONG_UNIT else self.whole(raw), np.int32)

    def units(self, part: Slice, wide: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the slice's units in order, but for those of ``wide`` documents: their document, and which distinct unit they
        are; of the distinct units, all ids and the bounds of each."""
        data, off = part.data, part.offsets
        _, end = bounds(data, off)
        # A unit ends where a word does; white space left at a document's end is one of its own.
        tails = off[1:][np.diff(off) > 0]
        if not len(tails):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64)
        end = np.sort(np.concatenate((end, tails[SPACE[data[tails - 1]]])))
        start = np.concatenate(([0], end[:-1])).astype(np.int64)
        doc = np.searchsorted(off, start, "right") - 1
        hashes = span_hash(data, start, end)
        if wide:
            keep = ~np.isin(doc, wide)
            start, end, doc, hashes = start[keep], end[keep], doc[keep], hashes[keep]
        if not len(doc):
            return doc, np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64)
        order = np.argsort(hashes)
        sorted_hashes = hashes[order]
        new = np.concatenate(([True], sorted_hashes[1:] != sorted_hashes[:-1]))
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        if not _same_bytes(data, start, end - start, first[which]):  # different units of one hash: told apart by their bytes
            seen: dict[bytes, int] = {}
            which = np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
            first = np.unique(which, return_index=True)[1]
        start, end = start[first], end[first]
        # Units that begin with white space and end with ink may follow one another in one text; the others go alone.
        size = end - start
        chained = SPACE[data[start]] & ~SPACE[data[end - 1]] & (size <= LONG_UNIT)
        a, n = start[chained], size[chained]
        total = np.concatenate(([0], np.cumsum(n)))
        text = data[np.repeat(a - total[:-1], n) + np.arange(total[-1])].tobytes().decode()
        ids = np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.int32) if text else np.zeros(0, np.int32)
        edge = np.concatenate(([0], np.cumsum(self.width[ids])))
        at = np.searchsorted(edge, total)
        if not np.array_equal(edge[at], total):
            raise AssertionError("a token reaches over a unit's end")
        alone = np.flatnonzero(~chained)
        more = [self._alone(data[start[k] : end[k]].tobytes()) for k in alone]
        # Chained units first, then the others.
        place = np.empty(len(start), np.int64)
        place[chained] = np.arange(len(a))
        place[alone] = len(a) + np.arange(len(alone))
        ids = np.concatenate([ids, *more])
        ends = np.concatenate((at, at[-1] + np.cumsum([len(m) for m in more]))).astype(np.int64)
        return doc, place[which], ids, ends

    def _wide(self, part: Slice) -> list[int]:
        """Documents that must be encoded whole."""
        raw = part.data.tobytes()
        return sorted({int(np.searchsorted(part.offsets, m.start(), "right")) - 1 for m in _WIDE_SPACE.finditer(raw)})

    def counts(self, part: Slice) -> np.ndarray:
        wide = self._wide(part)
        doc, which, _, ends = self.units(part, wide)
        out = np.bincount(doc, np.diff(ends)[which], minlength=part.hi - part.lo).astype(np.int64)
        for k in wide:
            out[k] = len(self.whole(part.data[part.offsets[k] : part.offsets[k + 1]].tobytes()))
        return out

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each document's bounds in them (one more at the end)."""
        wide = self._wide(part)
        doc, which, known, at = self.units(part, wide)
        size = np.diff(at)[which]
        ids = known[np.repeat(at[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        n = np.bincount(doc, size, minlength=part.hi - part.lo).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(n)))
        if wide:
            parts = [ids[ends[k] : ends[k + 1]] for k in range(len(n))]
            for k in wide:
                parts[k] = np.array(self.whole(part.data[part.offsets[k] : part.offsets[k + 1]].tobytes()), np.int32)
            ids, ends = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, ends


@functools.cache
def vocabulary_bytes(path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens, and the bounds of each by id."""
    enc = encoding(path)
    parts = [b""] * enc.n_vocab
    for token in enc.token_byte_values():
        parts[enc.encode_single_token(token)] = token
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


@functools.cache
def tokenizer(path: str = VOCABULARY) -> UnitTokenizer:
    """One a process."""
    return UnitTokenizer(path)


def column_counts(column: pa.Array, path: str = VOCABULARY) -> np.ndarray:
    t = tokenizer(path)
    parts = [t.counts(p) for p in slices(column, SLICE)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


