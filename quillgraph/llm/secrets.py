"""Operator 6: secret scan by token efficiency.

A vocabulary learnt from language spends few tokens on language and many on random strings. Words of at least
``least`` characters are cut into runs of key characters; a run with fewer than ``ratio`` characters a token, and of at
least two kinds of characters, is a find. A run without digits must also change between small and capital letters
at every fourth character or more often. UUIDs, numbers and dates are excluded, and so are the spans of e-mail addresses and
of links' schemes, hosts and paths; what else a word holds, such as a link's user name, password, query and fragment or
other fields of JSON, is searched. A run of 32, 40, 56, 64, 96 or 128 hexadecimal digits may be a key or a digest: it is
excluded if it is among ``known``, if a word that names digests or revisions (``sha256``, ``commit``, ``etag`` and the
like) stands right before it, or if it stands free in prose, as revisions are cited; as a value that is quoted or
assigned (after ``=``, ``:`` or a word that names credentials) it is searched like any other run.

Edge cases: null and empty texts have no finds; rows that repeat give theirs as often as they occur; a null doc_id gives
finds under null; other columns are unread. Positions are in characters, from 0, the end excluded.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii import _DOMAIN, _LOCAL
from .shared import tidy
from .tokens import VOCABULARY, encoding
from .words import slices, words

LEAST, RATIO = 16, 2.5
REACH = 24  # characters before a run in which a word may call it a digest
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CASE = np.zeros(256, np.int8)
_CASE[97:123], _CASE[65:91] = 1, 2
_KEY = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
_DIGESTS = {32, 40, 56, 64, 96, 128}
_CALLED = re.compile(r"(?:^|[^a-z])(?:sha-?\d{0,3}|md5|blake\w*|crc|(?:check|hash)sum|digest|hash|commit|revision|rev|etag|integrity|fingerprint|blob|tree|parent|uuid|guid|object id)[^a-z]*\Z", re.I)
_VALUE = re.compile(r"(?:[=:\"'`]|(?:token|secret|key|passw(?:or)?d|pwd|credential|bearer|auth\w*)(?:\s+is)?)\s*\Z", re.I)
_INTEGRITY = re.compile(r"(?:sha\d{1,3}|md5)[-_]", re.I)
_HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
_KNOWN = re.compile(
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z"  # UUID
    r"|[\d+/_\-=]+\Z"  # numbers, dates, telephone numbers
    r"|\d{4}-\d\d-\d\dT[\d:.\-+Z]*\Z"
)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{0,30}\Z")
_HOST_PATH = r"[^\s/?#&\"'`<>|,;(){}\[\]\\@=]*(?:/[^\s?#&\"'`<>|,;(){}\[\]\\]*)?"
_LINK = re.compile(r"(?P<user>[^\s/?#\"'`<>]*@)?(?P<rest>" + _HOST_PATH + ")")
_WWW = re.compile(r"(?<![A-Za-z0-9_.])www\." + _HOST_PATH)
_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+\-]")
_TURN = re.compile(r"(?=[a-z][A-Z]|[A-Z][a-z])")


def _without_addresses(word: str) -> str:
    """The word with blanks over its links' schemes, hosts and paths and its e-mail addresses."""
    out = word
    blank = lambda a, b: out[:a] + " " * (b - a) + out[b:]
    at = out.find("://")
    while at >= 0:
        scheme, link = _SCHEME.search(out, max(0, at - 31), at), _LINK.match(out, at + 3)
        out = blank(link.start("rest"), link.end())
        out = blank(scheme.start() if scheme else at, at + 3)
        at = out.find("://", link.end())
    if "www." in out:
        out = _WWW.sub(lambda m: " " * len(m.group()), out)
    at = out.find("@")
    while at >= 0:
        left, right = _LOCAL.search(out, max(0, at - 65), at), _DOMAIN.match(out, at + 1)
        if left and right and not (left.start() and _LOCAL_PART.match(out[left.start() - 1])):
            out = blank(left.start(), right.end())
        at = out.find("@", at + 1)
    return out


def _kinds(s: str) -> int:
    return any(c.isdigit() for c in s) + any("a" <= c <= "z" for c in s) + any("A" <= c <= "Z" for c in s)


def finds(word: str, enc, least: int = LEAST, ratio: float = RATIO, before: str = "", known: frozenset[str] = frozenset()) -> list[tuple[int, int, int, float]]:
    """(start, end, tokens, characters a token) of the secrets in a word; ``before`` is what the text has before it."""
    out = []
    for m in _KEY.finditer(_without_addresses(word) if "@" in word or "://" in word or "www." in word else word):
        s = m.group()
        bare = s.rstrip("=")
        if len(bare) < least or _kinds(bare) < 2 or _KNOWN.match(bare) or _INTEGRITY.match(bare):
            continue
        if len(bare) in _DIGESTS and _HEX.match(bare):
            near = (before + word[: m.start()])[-REACH:]
            if bare.lower() in known or _CALLED.search(near) or not _VALUE.search(near):
                continue
        if not any(c.isdigit() for c in bare) and 4 * len(_TURN.findall(bare)) < len(bare):
            continue
        n = len(enc.encode_ordinary(s))
        if len(s) / n < ratio:
            out.append((m.start(), m.end(), n, round(len(s) / n, 4)))
    return out


def scan(docs: DataFrame, least: int = LEAST, ratio: float = RATIO, path: str = VOCABULARY, known: frozenset[str] = frozenset()) -> DataFrame:
    """(doc_id, start, end, n_tokens, chars_per_token): a row for each find. ``known`` are digests in small letters; they
    travel to every task, so hand in a set that fits there."""

    def each(batches):
        enc = encoding(path)
        for batch in batches:
            rows = []
            ids = batch.column("doc_id")
            for part in slices(batch.column("text")):
                w = words(part)
                digits = np.zeros(len(part.data) + 1, np.int32)
                np.cumsum(_DIGIT[part.data], out=digits[1:])
                turns = np.zeros(len(part.data) + 1, np.int32)
                case = _CASE[part.data]
                np.cumsum(case[1:] * case[:-1] == 2, out=turns[2:])
                turned = 4 * (turns[w.end] - turns[np.minimum(w.start + 1, w.end)]) >= least
                chars = None
                for k in np.flatnonzero((w.end - w.start >= least) & ((digits[w.end] > digits[w.start]) | turned)):
                    a, b = int(w.start[k]), int(w.end[k])
                    d = int(np.searchsorted(w.first, k, "right")) - 1
                    near = part.data[max(int(part.offsets[d]), a - 4 * REACH) : a].tobytes().decode(errors="ignore")
                    found = finds(part.data[a:b].tobytes().decode(), enc, least, ratio, near, known)
                    if found:
                        if chars is None:  # characters before each byte of the slice
                            chars = np.zeros(len(part.data) + 1, np.int64)
                            np.cumsum((part.data & 0xC0) != 0x80, out=chars[1:])
                        at = int(chars[a] - chars[part.offsets[d]])
                        rows += [(ids[part.lo + d].as_py(), at + x, at + y, n, r) for x, y, n, r in found]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "start", "end", "n_tokens", "chars_per_token"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(each), "doc_id long, start int, end int, n_tokens int, chars_per_token double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
