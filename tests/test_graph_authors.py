from __future__ import annotations

import pytest
from quillgraph.operators import authors as au
from quillgraph.operators.graph import Graph

NAMES = "id string, display_name string, surname string, surname_norm string, canonical_given string, initials string, openalex_id string, orcid string, n_occurrences long, n_reference_citations long, n_distinct_papers_citing long"


@pytest.fixture(scope="module")
def graph(spark):
    papers = spark.createDataFrame([("p-1", "One", "Ecology", 2001), ("p-2", "Two", "Ecology", 2002), ("p-3", "Three", "", 2003), ("p-4", "Four", None, 2004)], "id string, Title string, Journal string, Year int")
    refs = spark.createDataFrame([("r-x", "X", "J", 1990), ("r-y", "Y", "J", 1991), ("r-z", "Z", "K", 1992), ("r-w", "W", "K", 1993)], papers.schema)
    edges = spark.createDataFrame([("p-1", "r-x"), ("p-1", "r-y"), ("p-1", "r-z"), ("p-2", "r-x"), ("p-2", "r-y"), ("p-3", "r-x"), ("p-3", "r-w"), ("p-4", "r-x"), ("p-4", "r-gone")], "citing_id string, cited_id string")
    authors = spark.createDataFrame([("a-munoz", "José Muñoz", "Muñoz", "munoz", "José", "J", None, None, 2, 2, 4), ("a-lee", "Lee, A.", "Lee", "lee", "A.", "A", None, None, 1, 1, 1)], NAMES)
    cites = spark.createDataFrame([("a-munoz", "reference", "r-x", 0, "", "Muñoz, J."), ("a-munoz", "reference", "r-y", 1, "", "J. Muñoz"), ("a-munoz", "paper", "p-1", 0, "", "J. Muñoz"), ("a-lee", "reference", "r-w", 0, "", "Lee, A.")], "author_id string, record_kind string, record_id string, position int, citing_paper_id string, raw_author string")
    return Graph(papers, refs, edges, authors, cites)


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_counts_and_neighbours(graph):
    assert tuple(graph.counts().first()) == (4, 4, 9) and "4 papers" in repr(graph)
    assert sorted(ids(graph.cited_by("p-1"))) == ["r-x", "r-y", "r-z"] and ids(graph.cited_by("nobody")) == []
    assert sorted(ids(graph.citers_of("r-y"))) == ["p-1", "p-2"] and ids(graph.citers_of("r-nothing")) == []


def test_top_cited_breaks_ties_by_id(graph):
    assert [(r.id, r.n_citations) for r in graph.top_cited(3).collect()] == [("r-x", 4), ("r-y", 2)]  # r-gone is third and no reference
    assert ids(graph.top_cited_authors(1)) == ["a-munoz"]
    empty = Graph(graph.papers, graph.references, graph.edges.limit(0))
    assert empty.top_cited().collect() == [] and "n_citations" in empty.top_cited().columns


@pytest.mark.parametrize(("query", "found"), [("MUNOZ", ["a-munoz"]), ("ñoz", ["a-munoz"]), ("e", ["a-lee", "a-munoz"]), ("a.", ["a-lee"]), (".*", []), ("  ", []), ("", [])])
def test_find_author(graph, query, found):
    assert sorted(ids(graph.find_author(query))) == found


def test_author_questions(graph):
    context = graph.citation_context("a-munoz").collect()
    assert [(r.citing_id, r.cited_id) for r in context] == [("p-1", "r-x"), ("p-1", "r-y"), ("p-2", "r-x"), ("p-2", "r-y"), ("p-3", "r-x"), ("p-4", "r-x")]
    assert {r.id: (r.citing_ids, r.n_citing) for r in graph.citations_of("a-munoz").collect()} == {"r-x": (["p-1", "p-2", "p-3", "p-4"], 4), "r-y": (["p-1", "p-2"], 2)}
    assert sorted(ids(graph.papers_citing_author("a-lee"))) == ["p-3"]
    assert [(r.paper_id, r.n_references, r.cited_titles) for r in graph.citing_papers_by_author("a-munoz").collect()] == [("p-1", 2, ["X", "Y"]), ("p-2", 2, ["X", "Y"]), ("p-3", 1, ["X"]), ("p-4", 1, ["X"])]
    assert [(r.journal, r.n_papers, r.share) for r in graph.source_journals_citing_author("a-munoz").collect()] == [("(unknown)", 2, 0.5), ("Ecology", 2, 0.5)]
    assert graph.citation_context("a-nobody").collect() == []


def test_author_tables_are_needed(graph):
    bare = Graph(graph.papers, graph.references, graph.edges)
    assert not bare.has_authors
    with pytest.raises(RuntimeError):
        bare.find_author("x")


def test_vertices_and_links(graph):
    assert graph.vertices().count() == 8 and graph.links().count() == 9


def test_load_names_everything_absent(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match=r"papers.*references.*citation_graph"):
        Graph.load(spark, str(tmp_path))


def people(spark, lists, mode="strict", joined=False, known=None):
    kind = "id string, Title string, Authors_List array<string>, Authors string, Year int, OpenAlex_Authors array<struct<display_name:string,openalex_id:string,orcid:string>>"
    rows = [(f"r-{k}", "T", None if joined else x, x if joined else None, 2000, (known or {}).get(k)) for k, x in enumerate(lists)]
    table, cites, looked = au.normalize_authors(spark.createDataFrame(rows, kind), mode=mode)
    return {r.id: r for r in table.collect()}, cites, looked


def test_initials_join_the_only_full_name(spark):
    table, cites, _ = people(spark, [["Ostrom, Elinor"], ["Ostrom, E."], ["E. Ostrom"]])
    assert list(table) == ["a-ostrom-elinor"] and table["a-ostrom-elinor"].n_occurrences == 3 and table["a-ostrom-elinor"].display_name == "Elinor Ostrom"
    assert cites.count() == 3


def test_two_full_names_keep_initials_apart_unless_coauthors_tell(spark):
    assert sorted(people(spark, [["Roe, Jane"], ["Roe, John"], ["Roe, J."]])[0]) == ["a-roe-j", "a-roe-jane", "a-roe-john"]
    table = people(spark, [["Roe, Jane", "Lee, A."], ["Roe, John", "Kim, B."], ["Roe, J.", "Kim, B."]])[0]
    assert table["a-roe-john"].n_occurrences == 2 and "a-roe-j" not in table


def test_middle_initials_and_loose_mode(spark):
    lists = [["Roe, J. A."], ["Roe, J. B."], ["Roe, J. B."]]
    assert sorted(people(spark, lists)[0]) == ["a-roe-ja", "a-roe-jb"]
    assert [r.n_occurrences for r in people(spark, lists, "loose")[0].values()] == [3]
    with pytest.raises(ValueError):
        people(spark, lists, "other")


def test_outside_ids_decide(spark):
    known = {0: [("Jane Roe", "A1", None)], 1: [("Jane Roe", "A2", None)], 2: [("J. Roe", "A1", None)]}
    table = people(spark, [["Roe, Jane"], ["Roe, Jane"], ["Roe, J."]], known=known)[0]
    assert sorted((r.openalex_id, r.n_occurrences) for r in table.values()) == [("A1", 2), ("A2", 1)]
    assert sorted(table) == ["a-roe-jane", "a-roe-jane-1"]


def test_joined_strings(spark):
    for joined, surnames in (("Smith, J., Núñez, A.", {"smith", "nunez"}), ("Smith, J.; Núñez, A.", {"smith", "nunez"}), ("Plott, Charles, Mark Isaac", {"plott", "isaac"})):
        assert {r.surname_norm for r in people(spark, [joined], joined=True)[0].values()} == surnames


def test_review_lists_frequent_bare_initials(spark):
    _, _, looked = people(spark, [["Roe, J."]] * 3 + [["Lee, A."]] * 2)
    assert [(r.author_id, r.n_occurrences, r.raw_strings) for r in looked.collect()] == [("a-roe-j", 3, ["Roe, J."])]


def test_aliases_follow_chains_and_survive_cycles(spark):
    pairs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("s", "s")], "cluster_id string, canonical_id string")
    assert sorted(map(tuple, au.resolve_aliases(pairs).collect())) == [("b", "a"), ("c", "a"), ("d", "a")]


def test_aliases_merge_counts(spark):
    refs = spark.createDataFrame([("r-1", ["Roe, Jane"]), ("r-2", ["Row, Jane"]), ("r-3", ["Lee, Al"])], "id string, Authors_List array<string>")
    edges = spark.createDataFrame([("p-1", "r-1"), ("p-1", "r-2"), ("p-2", "r-2"), ("p-3", "r-3")], "citing_id string, cited_id string")
    aliases = spark.createDataFrame([("a-row-jane", "a-roe-jane"), ("a-nobody", "a-lee-al")], "cluster_id string, canonical_id string")
    table, cites, _ = au.normalize_authors(refs, edges=edges, aliases=aliases)
    got = {r.id: (r.n_occurrences, r.n_reference_citations, r.n_distinct_papers_citing) for r in table.collect()}
    assert got == {"a-roe-jane": (2, 2, 2), "a-lee-al": (1, 1, 1)}
    assert sorted({r.author_id for r in cites.collect()}) == ["a-lee-al", "a-roe-jane"]


def test_citing_papers_are_counted_once_without_a_row_a_pair(spark):
    from quillgraph.operators import authors as au

    works = spark.createDataFrame([("a", "reference", "r1"), ("a", "reference", "r2"), ("a", "paper", "r3"), ("b", "reference", "r2"), ("c", "reference", "r9")], "author_id string, record_kind string, record_id string")
    edges = spark.createDataFrame([("p1", "r1"), ("p1", "r2"), ("p2", "r2"), ("p2", "r2"), ("p3", "r3")], "citing_id string, cited_id string")
    found = au.reference_citers_of(works, edges)
    assert {tuple(r) for r in found.collect()} == {("a", 2), ("b", 2)}
    assert "citing_id" not in found._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
