from __future__ import annotations

import json
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quillgraph.functions import names, similarity
from quillgraph.functions import text as tx


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


HEADERS = ["## References", "# references", "###### Bibliography", "## REFERENCE", "## References and Notes", "# References cited", "## Works cited", "### Literature Cited", "## Cited literature", "## 12. References", "# IV. Bibliography"]


@pytest.mark.parametrize("header", HEADERS)
def test_section_begins_at_its_header(spark, header):
    got = one(spark, f"Text before.\n\n{header}\n[1] A. Author. A work.\n", tx.reference_section(F.col("t")).alias("s")).s
    assert got == f"{header}\n[1] A. Author. A work.\n"


def test_the_last_of_several_headers_counts(spark):
    assert one(spark, "## References\nold\n## Works Cited\nnew", tx.reference_section(F.col("t")).alias("s")).s == "## Works Cited\nnew"


@pytest.mark.parametrize("text", ["", "no header", "## References for teachers\nprose", "as our references [3] show", "####### References\nx"])
def test_no_section(spark, text):
    r = one(spark, text, tx.reference_section(F.col("t")).alias("s"), tx.body(F.col("t")).alias("b"))
    assert r.s is None and r.b == text


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("", 0), ("see [4], [5, 6] and again [4]", 3), ("[10-13] and [10–12]", 3), ("[01] is [1]", 1), ("(Plott, 1985) and (Plott, 1985)", 1), ("(Plott, 1985; see below)", 0), ("Isaac (1985a) with Isaac and Plott (1988)", 2),
        ("(Isaac et al., 1985) differs from (Isaac, 1985)", 2), ("equation (2.4), part (7), try (99)", 0),
    ],
)
def test_inline_citations(spark, text, n):
    assert one(spark, text, tx.inline_citations(F.col("t")).alias("n")).n == n


@pytest.mark.parametrize(("text", "empty"), [("", True), ("# Title\n" * 90, True), ("<!-- image -->" * 99, True), ("x" * 199, True), ("x" * 200, False), ("# head\n" + "word " * 60, False)])
def test_image_only(spark, text, empty):
    assert one(spark, text, tx.is_image_only(F.col("t")).alias("e")).e is empty


def test_json_repair(spark):
    for text, expected in (('[{"k": 1}, {"k": 2}, {"k', [1, 2]), ("'[{\"k\": 5}]'", [5]), ('[{"k": 7}]', [7]), ('[{"k', None), ("", None)):
        r = one(spark, text, tx.repaired_json(F.col("t")).alias("r"), tx.structured(F.col("t"), "array<struct<k:int>>").alias("s"))
        assert (None if r.r is None else [x["k"] for x in json.loads(r.r)]) == expected
        assert (None if not r.s else [x.k for x in r.s]) == expected


def test_record_ids(spark):
    rows = [("Hardin, G.", 1968, "The Tragedy", None), (None, None, None, None), ("x", 1990, "A" * 60, ["Elinor Ostrom", "B C"]), ("Ann Lee and Bo Ek", 2001, "Ünïted; a long title that goes past forty characters", None)]
    got = [r.i for r in spark.createDataFrame(rows, "a string, y int, t string, l array<string>").select(tx.record_id("r", F.col("a"), F.col("y"), F.col("t"), F.col("l")).alias("i")).collect()]
    assert got[0] == "r-hardin-1968-the-tragedy"
    assert got[1] == "r-unknown-nd-untitled"
    assert got[2] == "r-ostrom-1990-" + "a" * 40
    assert got[3] == "r-lee-2001-united-a-long-title-that-goes-past-forty"


def test_accents_as_decomposition(spark):
    text = "Cárdenas Łódź ß ø Å é ǖ Ñ 日本 " + unicodedata.normalize("NFD", "Éü")
    assert one(spark, text, tx.unaccented(F.col("t")).alias("u")).u == names.unaccented(text)


def lcs_plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc é", max_size=25), st.text("abc é", max_size=25))
def test_similarity(a, b):
    assert similarity.lcs(a, b) == lcs_plain(a, b)
    assert similarity.ratio(a, b) == similarity.ratio(b, a) and 0 <= similarity.ratio(a, b) <= 100
    assert similarity.token_set(a, b) == similarity.token_set(b, a)
    assert similarity.ratio(a, a) == 100


def test_token_set_cases():
    assert similarity.token_set("", "a") == 0 and similarity.token_set("b a", "a b b") == 100 and similarity.token_set("a", "a c d") == 100
    assert similarity.token_set("kitten", "sitting") == similarity.ratio("kitten", "sitting")


PARSED = [
    ("Ostrom, E.", "Ostrom", "ostrom", "E", False), ("Ostrom, Elinor", "Ostrom", "ostrom", "E", True), ("Elinor Ostrom", "Ostrom", "ostrom", "E", True), ("E. Ostrom", "Ostrom", "ostrom", "E", False), ("Müller, J.-P.", "Müller", "muller", "JP", False),
    ("Müller, Jean-Paul", "Müller", "muller", "JP", True), ("Vargas Llosa, Mario", "Vargas Llosa", "vargas llosa", "M", True), ("Ludwig van der Berg", "van der Berg", "van der berg", "L", True), ("King, Martin Jr.", "King", "king", "M", True), ("Hardin, G.†", "Hardin", "hardin", "G", False),
]


@pytest.mark.parametrize(("raw", "surname", "norm", "initials", "full"), PARSED)
def test_parse(raw, surname, norm, initials, full):
    n = names.parse(raw)
    assert (n.surname, n.surname_norm, n.initials, n.full_first) == (surname, norm, initials, full)


@pytest.mark.parametrize("raw", [None, "", "  ", "et al.", "ANON", "n.a.", "***", "J.", "A. B.", "Q", 5])
def test_not_a_name(raw):
    assert names.parse(raw) is None


@pytest.mark.parametrize(
    ("joined", "parts"),
    [("Roe, J., Doe, A.", ["Roe, J.", "Doe, A."]), ("Roe, Jane, Doe, Ann", ["Roe, Jane", "Doe, Ann"]), ("Roe, J.; Doe, A. B.", ["Roe, J.", "Doe, A. B."]), ("Plott, Charles, Mark Isaac, Roy Savin", ["Plott, Charles", "Mark Isaac", "Roy Savin"]), ("", []), (None, [])],
)
def test_split_joined(joined, parts):
    assert names.split_joined(joined) == parts


def test_terms_and_any_author(spark):
    from quillgraph.operators import terms

    docs = spark.createDataFrame([("The theme and the sea", "en"), ("Die Dinge", "de"), (None, "en")], "text string, lang string")
    got = {(r.lang, r.term): r.n for r in terms.term_counts(docs, {"": ["the"], "de": ["di"]}).collect()}
    assert got == {("en", "the"): 3, ("de", "the"): 0, ("de", "di"): 2}
    assert terms.term_counts(docs, {}).collect() == []
    rows = spark.createDataFrame([("Ostrom,  ELINOR",), ("Hardin, G.",), (None,)], "a string")
    assert [r.h for r in rows.select(terms.has_any_author(F.col("a"), ["ostrom, elinor", " ", "putnam"]).alias("h")).collect()] == [True, False, False]


def test_public_names():
    import quillgraph

    assert all(getattr(quillgraph, n) is not None for n in quillgraph.__all__) and "Pipeline" in quillgraph.__all__
