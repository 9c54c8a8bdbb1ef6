"""Text analytics as Column expressions; all of it stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = r"#{1,6}\s+(?:[\dIVX]+\.?\s+)?(?:bibliography|references?|(?:works|literature)\s+cited|cited\s+literature)(?:\s+(?:cited|and\s+notes))?[ \t\f\r\x0B]*"
#: The text up to the last header, which stands alone on its line, and from there on.
SECTION = rf"(?is)\A((?:.*\n)?)({HEADER}(?:\n.*)?)\z"
NUMERIC = r"\[([\d,\s\-–]+)\]"
NAMES = r"[A-Z][A-Za-z\-']+(?:\s+(?:&|and)\s+[A-Z][A-Za-z\-']+)?(?:\s+et\s+al\.?)?"
PARENTHETIC = rf"\(({NAMES}),?\s+(\d{{4}})[a-z]?\)"
NARRATIVE = rf"\b({NAMES})\s+\((\d{{4}})[a-z]?\)"

METADATA_CHARS, METADATA_PROMPT, REFERENCES_PROMPT = 12_000, 560, 1060
CHARS_PER_TOKEN, CHARS_PER_REFERENCE = 4, 175
METADATA_OUTPUT, REFERENCE_OUTPUT = 300, 75


def is_image_only(content: Column, least: int = 200) -> Column:
    """Whether hardly any text is left without image marks and headings."""
    lines = F.split(F.replace(content, F.lit("<!-- image -->"), F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]")
    kept = F.filter(lines, lambda x: ~F.regexp_like(x, F.lit(r"^\s*#")))
    return F.length(strip(F.array_join(kept, ""))) < least


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def reference_section(content: Column) -> Column:
    """From the last bibliography header on, or null."""
    found = F.regexp_extract(content, SECTION, 2)
    return F.when(found != "", found)


def body(content: Column) -> Column:
    section = reference_section(content)
    return F.coalesce(F.substring(content, F.lit(1), F.length(content) - F.length(section)), content)


def inline_citations(text: Column) -> Column:
    """Distinct bracketed numbers plus distinct author and year pairs."""
    groups = F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(1))
    numbers = F.filter(F.flatten(F.transform(groups, lambda g: F.split(g, r"[,\s\-–]+"))), lambda x: F.regexp_like(x, F.lit(r"^\d+$")))
    numbers = F.array_distinct(F.transform(numbers, lambda x: F.regexp_replace(x, "^0+", "")))

    def pairs(pattern: str) -> Column:
        who, when = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
        return F.zip_with(who, when, lambda a, y: F.concat_ws("|", F.regexp_replace(strip(F.lower(a)), r"\s+", " "), y))

    return F.size(numbers) + F.size(F.array_union(pairs(PARENTHETIC), pairs(NARRATIVE)))


def undercounted(found: Column, estimate: Column, extracted: Column) -> Column:
    """Whether far fewer references were extracted than the text cites; only where there is a section."""
    return found & (estimate >= 10) & (extracted < 0.5 * estimate)


def metadata_input(content: Column, chars: int = METADATA_CHARS) -> Column:
    return F.substring(content, 1, chars) if chars else content


def repaired_json(text: Column) -> Column:
    """A JSON list that was cut off, closed after its last whole object; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^'", ""), r"'$", "")
    head = F.regexp_extract(bare, r"(?s)\A(.*\})", 1)
    return F.when(head != "", F.concat(head, F.lit("\n]")))


def structured(text: Column, kind: str) -> Column:
    """Parsed JSON, of the repaired text if need be; null if neither works."""
    return F.coalesce(F.from_json(text, kind), F.from_json(repaired_json(text), kind))


def truncated(reasons: Column) -> Column:
    return F.exists(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: F.contains(r, F.lit("MAX_TOKENS")))


def tokens(chars: Column) -> Column:
    return F.ceil(chars / CHARS_PER_TOKEN).cast("long")


def normalized(text: Column) -> Column:
    """Lower case, stripped, ASCII letters, digits and white space only; null gives ''."""
    return F.regexp_replace(strip(F.lower(F.coalesce(text, F.lit("")))), r"[^a-zA-Z0-9\s]", "")


def _folding() -> tuple[str, str]:
    source, target = [], []
    for code in range(0xA0, 0x10000):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.category(parts[0]) != "Mn" and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            source.append(c)
            target.append(parts[0])
    return "".join(source), "".join(target)


_FROM, _TO = _folding()


def unaccented(text: Column) -> Column:
    """Without combining marks, precomposed or not (canonical decomposition within the basic plane)."""
    return F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{Mn}", "")


def surname_key(surname: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(unaccented(surname)), r"[^a-z\s]", ""), r"\s+", " "))


def first_author(authors: Column, listed: Column | None = None) -> Column:
    """Lower-case surname of the first author; of the list, where there is one. 'unknown' if nothing is left."""
    one = F.split_part(authors, F.lit(";"), F.lit(1))
    one = F.when(~F.contains(one, F.lit(",")) & F.contains(one, F.lit(" and ")), F.split_part(one, F.lit(" and "), F.lit(1))).otherwise(one)
    if listed is not None:
        one = F.when(listed.isNotNull(), F.coalesce(F.try_element_at(listed, F.lit(1)), F.lit(""))).otherwise(one)
    one = strip(one)
    parts = F.filter(F.split(one, "[^a-zA-Z]+"), lambda t: t != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    surname = F.when(F.contains(one, F.lit(",")), F.split_part(one, F.lit(","), F.lit(1))).otherwise(last)
    bare = F.lower(F.regexp_replace(surname, r"[^\p{L}]", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("unknown"))


def slug(text: Column, longest: int = 0) -> Column:
    """Lower-case ASCII words joined by hyphens; cut at a word's end if longer than ``longest``."""
    full = F.regexp_replace(F.regexp_replace(F.lower(unaccented(text)), "[^a-z0-9]+", "-"), "^-|-$", "")
    if not longest:
        return full
    words = F.regexp_extract(F.concat(full, F.lit("-")), f"^(.{{1,{longest}}})-", 1)
    return F.when(words != "", words).otherwise(F.regexp_replace(F.substring(full, 1, longest), "-$", ""))


def record_id(prefix: str, authors: Column, year: Column, title: Column, listed: Column | None = None) -> Column:
    """prefix-author-year-title; 'nd' and 'untitled' stand for what is missing."""
    when = F.coalesce(F.nullif(year.cast("string"), F.lit("")), F.lit("nd"))
    name = F.coalesce(F.nullif(slug(F.coalesce(title, F.lit("")), 40), F.lit("")), F.lit("untitled"))
    return F.concat_ws("-", F.lit(prefix), first_author(authors, listed), when, name)


def title_block(title: Column, words: int = 6) -> Column:
    parts = F.filter(F.split(normalized(title), r"\s+"), lambda x: x != "")
    return F.array_join(F.slice(parts, 1, words), " ")
