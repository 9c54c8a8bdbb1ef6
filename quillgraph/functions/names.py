"""Author names: splitting joined strings and parsing single names. Plain Python, used inside Arrow and pandas functions."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

PARTICLES = frozenset("abu al bin da das de del den der di do dos du el ibn la las le lo los ten ter van von".split())
NOBODY = frozenset(("unknown", "na", "n.a.", "anon", "anonymous", "et al.", "et al"))
_MARKS = re.compile(r"[*★†‡§¶]+|^\s*(?:&|and)\s+", re.I)
_SUFFIX = re.compile(r"\b(Esq\.?|III|II|IV|Jr\.?|M\.?D\.?|PhD\.?|Sr\.?)\b", re.I)
_RUN = re.compile(r"[a-zA-ZÀ-ÖØ-öø-ÿ]+")


class Name(NamedTuple):
    raw: str
    surname: str
    surname_norm: str
    given: list[str]
    initials: str
    full_first: bool
    suffix: str | None

    @property
    def first_initial(self) -> str:
        return self.initials[:1]

    @property
    def first_norm(self) -> str:
        return unaccented(self.given[0]).lower().strip(".-") if self.given else ""

    @property
    def display(self) -> str:
        return f"{self.surname}, {' '.join(self.given)}" if self.given else self.surname


def unaccented(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


def surname_key(s: str) -> str:
    return " ".join(re.sub(r"[^a-z\s]", "", unaccented(s).lower()).split())


def initials_only(token: str) -> bool:
    found = _RUN.findall(token)
    return bool(found) and max(map(len, found)) == 1


def parse(raw) -> Name | None:
    """The parsed name, or None where there is no surname to be had."""
    if not isinstance(raw, str) or unaccented(raw.strip()).lower() in NOBODY:
        return None
    s = " ".join(_MARKS.sub(" ", raw.strip()).split())
    suffix = None
    if found := _SUFFIX.search(s):
        suffix = found.group(1)
        s = (s[: found.start()] + s[found.end() :]).strip(", ")
    if "," in s:
        surname, _, rest = s.partition(",")
        given = rest.split()
    else:
        parts = s.split()
        k = max(len(parts) - 1, 0)
        while k and parts[k - 1].strip("-.").lower() in PARTICLES:
            k -= 1
        surname, given = " ".join(parts[k:]), parts[:k]
    surname = surname.strip(" -.")
    if not _RUN.search(surname) or initials_only(surname):
        return None
    initials = "".join(run[0].upper() for token in given for run in _RUN.findall(token))
    return Name(raw, surname, surname_key(surname), given, initials, bool(given) and not initials_only(given[0]), suffix)


def _pairs_up(family: str, given: str) -> bool:
    own, other = family.split(), given.split()
    if not own or not 0 < len(other) < 3:
        return False
    return len(own) == 1 or any(w.strip("-.").lower() in PARTICLES for w in own[:-1])


def split_joined(s: str | None) -> list[str]:
    """Names of a joined string: semicolons divide; else commas do, and 'Family, Given' is put together again."""
    s = (s or "").strip()
    if ";" in s:
        return [p for p in map(str.strip, s.split(";")) if p]
    parts = [p for p in map(str.strip, s.split(",")) if p]
    out: list[str] = []
    while parts:
        head = parts.pop(0)
        if parts and not initials_only(head) and (initials_only(parts[0]) or _pairs_up(head, parts[0])):
            head = f"{head}, {parts.pop(0)}"
        out.append(head)
    return out


def row_names(listed, joined) -> list[str]:
    """A record's author strings: its list, where that is one; a list of one joined string is split."""
    if listed is not None and len(listed):
        items = [str(x) for x in listed if x is not None]
        return split_joined(items[0]) if len(items) == 1 and (";" in items[0] or items[0].count(",") > 1) else items
    return split_joined(joined)


parse_author = parse
