"""Small corpora with every awkward case, and what several tests ask of them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Names that operators use inside; none of them may disturb or be disturbed.
EXTRA = "score double, bucket int, kind string, row string, leaf int, grp long, part int, size int, label int, lead long, sig long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
_NONE = (None,) * 11


def prose(n: int, seed: int, words: int = 400) -> str:
    r = random.Random(seed)
    out = []
    while len(out) < n:
        out += [f"w{r.randrange(words)}" for _ in range(r.randint(4, 12))]
        out[-1] += "."
    return " ".join(out[:n])


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text) with all other columns present."""
    full = [(i, t, "en", "s", None if t is None else len(t), 0.5, 3, "k", "r", 1, 7, 2, 9, 0, 5, 6) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward() -> list[tuple]:
    """Null ids and texts, empty and blank ones, one very long, ties, repeated rows, odd white space, emoji."""
    long = prose(30_000, 1)
    passage = prose(70, 2)
    return [
        (1, None), (2, ""), (3, " \n\t "), (None, prose(80, 3)), (None, None), (4, long), (5, prose(120, 4) + "\n" + passage), (6, passage + " " + prose(40, 5)),
        (7, prose(90, 6)), (8, prose(90, 6)), (9, prose(90, 6)), (10, "one"), (10, "one"), (11, "é ü ß 🙂 日本語 ١٢٣"), (12, "x" * 9000), (13, "...!!!"), (14, long),
        (15, "'s 't 'll\r\n  a  b c"), (16, passage),
    ]
