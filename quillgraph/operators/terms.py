"""Terms of a dictionary in documents, and people in author lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_counts(docs: DataFrame, terms: dict[str, list[str]], text: str = "text", by: str = "lang") -> DataFrame:
    """(by, term, n): how often each of a dictionary's terms begins a word, whatever the case, in the documents of each value
    of ``by``. ``terms`` holds lists by such a value, "" for all; the dictionary is a literal of the plan, so it is meant to be
    short. Terms are regular expressions over small letters."""
    wanted = F.array(*[F.struct(F.lit(k).alias("of"), F.lit(t).alias("term")) for k, ts in terms.items() for t in ts])
    if not any(terms.values()):
        return docs.select(by, F.lit("").alias("term"), F.lit(0).cast("long").alias("n")).limit(0)
    each = docs.select(by, F.lower(text).alias("__t"), F.explode(wanted).alias("__w")).where((F.col("__w.of") == "") | (F.col("__w.of") == F.col(by)))
    return each.select(by, F.col("__w.term").alias("term"), "__t").groupBy(by, "term").agg(F.sum(F.expr("regexp_count(__t, concat('(?:^|[^a-z])', term))")).cast("long").alias("n"))


def has_any_author(authors: Column, names: list[str]) -> Column:
    """Whether one of the names is in the authors' text, whatever the case and width of blanks."""
    tidy = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    hits = [F.contains(tidy(F.coalesce(authors, F.lit(""))), tidy(F.lit(n))) for n in names if n.strip()]
    out = F.lit(False)
    for hit in hits:
        out = out | hit
    return out
