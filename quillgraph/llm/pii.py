"""Operator 8: personal data. Patterns propose spans, checksums confirm them, nearby words move the score.

Kinds: e-mail, IPv4 address, telephone number, payment card (Luhn), IBAN (mod 97), US social security number. A span's score
is its pattern's, raised by words within ``REACH`` characters on either side that name its kind, lowered by words before it that
name another (what follows a number names the next thing more often); spans of at least ``threshold`` count.
Where spans overlap the higher score wins, then the longer, then the earlier. Digits are the ASCII ones. Whole texts are
searched; those without a digit and without an at sign hold no span and are told apart by their bytes first.

Edge cases: null and empty texts have no spans; redaction leaves them as they are. Rows that repeat give their spans as
often as they occur; a null doc_id gives spans under null; other columns pass through redaction unread. Positions are
in characters (code points), from 0, the end excluded.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import release, tidy
from .words import slices

THRESHOLD, REACH = 0.5, 48
_CUE = np.zeros(256, bool)
_CUE[48:58] = _CUE[64] = True
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,63})\Z")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9\-])")
_IPV4 = re.compile(r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])")
_PHONE = re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[.\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![\w+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9])")
_GROUPS = re.compile(r"(?<![0-9])(?<![0-9]\.)[0-9]+(?:[ \-][0-9]+)*")
_CARD_SHAPES = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3)}
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])")
_BASE = {"email": 0.9, "ip": 0.7, "phone": 0.7, "card": 0.8, "iban": 0.9, "ssn": 0.6}
_FOR = {
    "email": r"e-?mail|mail|contact|reply",
    "ip": r"ip|host|server|address|login|logged",
    "phone": r"phone|tel|call|mobile|fax|dial|contact",
    "card": r"card|visa|mastercard|amex|credit|debit|payment|pay",
    "iban": r"iban|account|bank|transfer",
    "ssn": r"ssn|social|security|taxpayer",
}
_AGAINST = {"ip": r"version|release|build|v", "phone": r"isbn|order|invoice|serial|part", "card": r"isbn|order|tracking|serial|invoice|sku", "ssn": r"isbn|part|serial|order", "iban": r"serial|part", "email": r"(?!)"}
_FOR, _AGAINST = ({k: re.compile(rf"(?<![a-z])(?:{v})(?![a-z])", re.I) for k, v in x.items()} for x in (_FOR, _AGAINST))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _cards(run: str) -> list[tuple[int, int]]:
    """Bounds of the cards in a run of digit groups: the whole run, however grouped, or else its sub-runs that are one
    group or grouped as cards are (in lists of numbers any other sub-run would often pass by chance). Of sub-runs that
    overlap the longer wins, then the earlier."""
    groups = [(g.start(), g.end()) for g in re.finditer(r"[0-9]+", run)]
    digits = run.replace(" ", "").replace("-", "")
    first = [0]
    for a, b in groups:
        first.append(first[-1] + b - a)
    good = []
    for i in range(len(groups)):
        for j in range(i + 1, len(first)):
            n = first[j] - first[i]
            if n > 19:
                break
            body = digits[first[i] : first[j]]
            shape = tuple(b - a for a, b in groups[i:j])
            whole = j - i == len(groups)
            if n >= 13 and (whole or len(shape) == 1 or shape in _CARD_SHAPES) and len(set(body)) > 1 and luhn(body):
                good.append((not whole, -n, i, j))
    free, out = [True] * len(groups), []
    for *_, i, j in sorted(good):
        if all(free[i:j]):
            free[i:j] = [False] * (j - i)
            out.append((groups[i][0], groups[j - 1][1]))
    return sorted(out)


def _proposed(text: str):
    at = text.find("@")
    while at >= 0:
        left, right = _LOCAL.search(text, max(0, at - 65), at), _DOMAIN.match(text, at + 1)
        if left and right and ".." not in left.group():
            yield "email", left.start(), right.end()
        at = text.find("@", at + 1)
    for m in _IPV4.finditer(text):
        if all(int(x) < 256 for x in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 7 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield "phone", m.start(), m.end()
    for m in _GROUPS.finditer(text):
        if m.end() - m.start() >= 13:
            yield from (("card", m.start() + a, m.start() + b) for a, b in _cards(m.group()))
    for m in _IBAN.finditer(text):
        found = m.group()
        while len(found.replace(" ", "")) >= 15:  # capitals after the number may have been taken in
            if mod97(found):
                yield "iban", m.start(), m.start() + len(found)
                break
            found = found[: found.rfind(" ")] if " " in found else ""
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), in order of place and none over another."""
    if not text:
        return []
    found = []
    for kind, a, b in _proposed(text):
        before, after = text[max(0, a - REACH) : a], text[b : b + REACH]
        named = bool(_FOR[kind].search(before) or _FOR[kind].search(after))
        score = min(1.0, max(0.0, round(_BASE[kind] + 0.1 * named - 0.3 * bool(_AGAINST[kind].search(before)), 2)))
        if score >= threshold:
            found.append((kind, a, b, score))
    if len(found) < 2:
        return found
    found.sort(key=lambda s: (s[1], s[2]))
    taken: list = []
    lo, end = 0, found[0][2]
    for hi in range(1, len(found) + 1):  # spans that overlap, directly or by others, are settled among themselves
        if hi < len(found) and found[hi][1] < end:
            end = max(end, found[hi][2])
            continue
        taken += found[lo:hi] if hi - lo == 1 else _settled(found[lo:hi])
        if hi < len(found):
            lo, end = hi, found[hi][2]
    return taken


def _settled(group: list) -> list:
    """Of spans that overlap the higher score, then the longer, then the earlier; in order of place."""
    starts: list[int] = []
    taken: list = []
    for s in sorted(group, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
        k = bisect.bisect_left(starts, s[2])  # of those taken only the last that begins before s ends can reach into it
        if not k or taken[k - 1][2] <= s[1]:
            starts.insert(k, s[1])
            taken.insert(k, s)
    return taken


def _cued(column: pa.Array) -> list[int]:
    """Rows with a digit or an at sign."""
    out = []
    for part in slices(column):
        hit = np.flatnonzero(_CUE[part.data])
        rows = np.searchsorted(part.offsets, hit, "right") - 1
        out += (part.lo + rows[np.concatenate(([True], rows[1:] != rows[:-1]))]).tolist() if len(rows) else []
    return out


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kind, start, end, score): a row for each span."""

    def each(batches):
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            rows = [(ids[k].as_py(), *s) for k in _cued(text) for s in spans(text[k].as_py(), threshold)]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "kind", "start", "end", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(each), "doc_id long, kind string, start int, end int, score double")


def redacted(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, in their own columns, with each span of ``text`` replaced by its kind in angle brackets, and ``n_chars``, if
    there is one, set to the new length. Every row stays."""

    @F.arrow_udf("string")
    def hide(text: pa.Array) -> pa.Array:
        changed = {}
        for k in _cued(text):
            t = text[k].as_py()
            found = spans(t, threshold)
            if found:
                out, at = [], 0
                for kind, a, b, _ in found:
                    out += [t[at:a], f"<{kind.upper()}>"]
                    at = b
                changed[k] = "".join([*out, t[at:]])
        if not changed:
            return text
        out = pa.array([changed.get(k) if k in changed else text[k].as_py() for k in range(len(text))], pa.string())
        release()
        return out

    out = docs.withColumn("text", hide(docs["text"].cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
