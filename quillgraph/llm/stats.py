"""Document statistics, vectorised over Arrow buffers. Both quality operators use them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import Slice, Words, slices, words

NAMES = (
    "log_words", "mean_word_bytes", "symbol_ratio", "upper_ratio", "digit_ratio", "space_ratio", "newline_ratio", "pipe_ratio",
    "distinct_ratio", "repeat_next_ratio", "repeat_line_ratio", "long_word_ratio", "bang_ratio", "high_byte_ratio", "stop_ratio", "symbol_word_ratio",
)

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = _LETTER[128:] = True
_CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": (9, 10, 11, 12, 13, 32),
    "newline": (10,),
    "pipe": (124,),
    "bang": (33, 63),
    "high": range(128, 256),
    "symbol": [*range(35, 39), 42, 43, 47, *range(60, 63), 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126],
}
_CODE = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def slice_stats(part: Slice, w: Words) -> np.ndarray:
    """One row a document, a column for each of NAMES. A null or empty text gives zeros throughout."""
    data, off = part.data, part.offsets
    size = np.maximum(np.diff(off), 1).astype(float)
    n = np.diff(w.first)
    some = np.maximum(n, 1).astype(float)
    doc = w.doc()
    length = w.end - w.start
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=letters[1:])
    # The bytes by class, counted once through the histogram of (document, byte).
    lead = np.repeat(np.arange(len(n)), np.diff(off))
    seen = np.bincount(lead * 256 + data, minlength=256 * len(n)).reshape(-1, 256) if len(data) else np.zeros((len(n), 256))
    count = {k: seen[:, v].sum(1) for k, v in _CODE.items()}
    alpha = np.maximum(seen[:, _LETTER].sum(1), 1)

    def by_doc(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=len(n))

    order = np.argsort((doc.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)), kind="stable")
    d, h = doc[order], w.hash[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    distinct = np.bincount(d[new], minlength=len(n))
    same = np.zeros(len(doc), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    span = (letters[w.end] - letters[w.start]) if len(w.start) else np.zeros(0, np.int64)

    # Lines: hash of the words between newlines, by prefix sums; repeated ones within the document count.
    newline = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=newline[1:])
    line = newline[w.start] if len(w.start) else np.zeros(0, np.int64)
    key = (doc.astype(np.int64) << 32) + line
    begin = np.ones(len(key), bool)
    begin[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(begin)
    if len(first):
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        sums = np.add.reduceat(w.hash * (2 * place.astype(np.uint64) + np.uint64(1)), first)
        at = doc[first]
        o = np.lexsort((sums, at))
        again = np.zeros(len(o), bool)
        again[1:] = (at[o][1:] == at[o][:-1]) & (sums[o][1:] == sums[o][:-1])
        lines, repeated = np.bincount(at, minlength=len(n)), np.bincount(at[o][again], minlength=len(n))
    else:
        lines = repeated = np.zeros(len(n))
    out = np.zeros((len(n), len(NAMES)), np.float64)
    out[:, 0] = np.log1p(n)
    out[:, 1] = np.bincount(doc, length, minlength=len(n)) / some
    out[:, 2] = count["symbol"] / size
    out[:, 3] = count["upper"] / alpha
    out[:, 4] = count["digit"] / size
    out[:, 5] = count["space"] / size
    out[:, 6] = count["newline"] / size
    out[:, 7] = count["pipe"] / size
    out[:, 8] = distinct / np.sqrt(some)  # a long text repeats words; the square root keeps lengths comparable
    out[:, 9] = by_doc(same) / some
    out[:, 10] = repeated / np.maximum(lines, 1)
    out[:, 11] = by_doc(length > 20) / some
    out[:, 12] = count["bang"] / size
    out[:, 13] = count["high"] / size
    out[:, 14] = by_doc(length <= 3) / some
    out[:, 15] = by_doc(span * 2 < length) / some
    out[np.diff(off) == 0] = 0
    return out


def column_stats(column: pa.Array) -> np.ndarray:
    parts = [slice_stats(p, words(p)) for p in slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))
