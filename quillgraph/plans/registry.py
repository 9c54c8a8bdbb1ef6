"""Queries over the driver's tables and the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions import text as tx
from ..operators import authors as au
from ..operators import dedup as dd
from ..operators import enrich as en
from ..operators import evaluate as ev
from ..operators import terms
from ..operators.graph import Graph, joined
from ..sources import adapters as ad
from ..sources import files
from . import pipeline as pl

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its check."""

    def add(fn):
        name = fn.__name__
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = ad.sql(sql)
        return fn

    return add


def _graph(spark: SparkSession, d: str) -> Graph:
    ac = ad.author_citations(spark, d)
    n = ac.groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("n_reference_citations"))
    return Graph(ad.papers(spark, d), ad.references(spark, d), ad.edges(spark, d), ad.author_names(spark, d).join(n, "id"), ac)


# The graph

@query("SELECT (SELECT count(*) FROM papers) AS n_papers, (SELECT count(*) FROM refs) AS n_references, (SELECT count(*) FROM edges) AS n_edges")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).counts()


@query("SELECT * FROM refs WHERE id IN (SELECT cited_id FROM edges WHERE citing_id = 'p-7')")
def cited_by(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).cited_by("p-7")


@query("SELECT * FROM papers WHERE id IN (SELECT citing_id FROM edges WHERE cited_id = 'r-7')")
def citers_of(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).citers_of("r-7")


@query("SELECT r.id, r.Title, r.Journal, r.Year, t.n_citations FROM (SELECT cited_id, count(*) AS n_citations FROM edges GROUP BY cited_id ORDER BY n_citations DESC, cited_id LIMIT 20) t JOIN refs r ON r.id = t.cited_id")
def top_cited(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).top_cited().select("id", "Title", "Journal", "Year", "n_citations")


_AUTHORS = "SELECT n.id, n.display_name, count(*) AS n_reference_citations FROM names n JOIN ac ON ac.author_id = n.id GROUP BY ALL"


@query("SELECT a.author_id AS id, count(DISTINCT a.record_id) AS n_reference_citations, count(DISTINCT e.citing_id) AS n_distinct_papers_citing FROM ac a LEFT JOIN edges e ON e.cited_id = a.record_id GROUP BY a.author_id")
def authors_table(spark: SparkSession, d: str) -> DataFrame:
    ac, edges = ad.author_citations(spark, d), ad.edges(spark, d)
    own = ac.groupBy(F.col("author_id").alias("id")).agg(F.countDistinct("record_id").alias("n_reference_citations"))
    papers = au.reference_citers_of(ac, edges).select(F.col("author_id").alias("id"), F.col("n").alias("papers"))
    return own.join(papers, "id", "left").select("id", "n_reference_citations", F.coalesce("papers", F.lit(0)).cast("long").alias("n_distinct_papers_citing"))


@query(f"{_AUTHORS} ORDER BY n_reference_citations DESC, id LIMIT 20")
def top_cited_authors(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).top_cited_authors().select("id", "display_name", "n_reference_citations")


@query(f"SELECT id, display_name FROM ({_AUTHORS}) WHERE contains(lower(strip_accents(display_name)), lower(strip_accents('ÉR#000')))".replace("É", "E"))
def find_author(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).find_author("ÉR#000").select("id", "display_name")


_CONTEXT = "SELECT a.author_id, coalesce(n.display_name, '') AS author_display_name, e.citing_id, p.Title AS citing_title, p.Journal AS citing_journal, p.Year AS citing_year, e.cited_id, r.Title AS cited_title, r.Journal AS cited_journal, r.Year AS cited_year, a.position, a.raw_author FROM edges e JOIN ac a ON a.record_id = e.cited_id AND a.author_id = 'a-7' LEFT JOIN papers p ON p.id = e.citing_id LEFT JOIN refs r ON r.id = e.cited_id LEFT JOIN names n ON n.id = a.author_id"


@query(_CONTEXT)
def citation_context(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).citation_context("a-7")


@query("SELECT r.id, r.Title, string_agg(DISTINCT e.citing_id, '|' ORDER BY e.citing_id) AS citing_ids, CAST(count(DISTINCT e.citing_id) AS INTEGER) AS n_citing FROM edges e JOIN refs r ON r.id = e.cited_id WHERE e.cited_id IN (SELECT record_id FROM ac WHERE author_id = 'a-7') GROUP BY r.id, r.Title")
def citations_of(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).citations_of("a-7").select("id", "Title", joined(F.col("citing_ids")).alias("citing_ids"), "n_citing")


@query("SELECT * FROM papers WHERE id IN (SELECT citing_id FROM edges WHERE cited_id IN (SELECT record_id FROM ac WHERE author_id = 'a-7'))")
def papers_citing_author(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).papers_citing_author("a-7")


@query(f"SELECT citing_id AS paper_id, citing_title AS Title, citing_journal AS Journal, citing_year AS Year, count(DISTINCT cited_id) AS n_references, string_agg(DISTINCT cited_id, '|' ORDER BY cited_id) AS cited_ids FROM ({_CONTEXT}) GROUP BY ALL")
def citing_papers_by_author(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).citing_papers_by_author("a-7").select("paper_id", "Title", "Journal", "Year", "n_references", joined(F.col("cited_ids")).alias("cited_ids"))


@query(f"SELECT coalesce(nullif(citing_journal, ''), '(unknown)') AS journal, count(DISTINCT citing_id) AS n_papers, round(count(DISTINCT citing_id) / sum(count(DISTINCT citing_id)) OVER (), 9) AS share FROM ({_CONTEXT}) GROUP BY 1")
def source_journals_citing_author(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).source_journals_citing_author("a-7").withColumn("share", F.round("share", 9))


@query("SELECT id, 'paper' AS kind FROM papers UNION ALL SELECT id, 'reference' AS kind FROM refs")
def graph_vertices(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).vertices()


@query("SELECT citing_id AS src, cited_id AS dst FROM edges")
def graph_links(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).links()


@query("SELECT cited_id, string_agg(citing_id, '|' ORDER BY citing_id) AS citing_ids FROM edges GROUP BY cited_id")
def reference_citers(spark: SparkSession, d: str) -> DataFrame:
    return au.reference_citers(ad.edges(spark, d)).select("cited_id", joined(F.col("citing_ids")).alias("citing_ids"))


# Documents

@query("SELECT doc_id, 'no text layer' AS reason FROM documents WHERE length(regexp_replace(array_to_string(list_filter(regexp_split_to_array(replace(text, '<!-- image -->', ''), '\\n'), lambda x: NOT regexp_matches(x, '^\\s*#')), ''), '^\\s+|\\s+$', '', 'g')) < 200")
def image_only_docs(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "documents").where(tx.is_image_only(F.col("text"))).select("doc_id", F.lit("no text layer").alias("reason"))


_SECTION_SQL = r"nullif(regexp_extract(content, '(?is)\A((?:.*\n)?)(#{1,6}\s+(?:[\dIVX]+\.?\s+)?(?:bibliography|references?|(?:works|literature)\s+cited|cited\s+literature)(?:\s+(?:cited|and\s+notes))?[ \t\f\r\v]*(?:\n.*)?)\z', 2), '')"


@query(f"SELECT doc_id, coalesce({_SECTION_SQL}, content) AS section, {_SECTION_SQL} IS NOT NULL AS found FROM md")
def references_slice(spark: SparkSession, d: str) -> DataFrame:
    section = tx.reference_section(F.col("content"))
    return ad.markdown(spark, d).select("doc_id", F.coalesce(section, F.col("content")).alias("section"), section.isNotNull().alias("found"))


_NAMES_SQL = r"[A-Z][A-Za-z\-'']+(?:\s+(?:&|and)\s+[A-Z][A-Za-z\-'']+)?(?:\s+et\s+al\.?)?"
_PAIRS_SQL = "list_transform(list_zip(regexp_extract_all({t}, '{p}', 1), regexp_extract_all({t}, '{p}', 2)), lambda z: lower(regexp_replace(z[1], '\\s+', ' ', 'g')) || '|' || z[2])"
_INLINE_SQL = (
    "CAST(len(list_distinct(list_transform(list_filter(flatten(list_transform(regexp_extract_all({t}, '\\[([\\d,\\s\\-–]+)\\]', 1), lambda g: regexp_split_to_array(g, '[,\\s\\-–]+'))), lambda x: regexp_matches(x, '^\\d+$')), lambda x: regexp_replace(x, '^0+', '')))) + len(list_distinct(list_concat("
    + _PAIRS_SQL.replace("{p}", rf"\(({_NAMES_SQL}),?\s+(\d{{4}})[a-z]?\)")
    + ", "
    + _PAIRS_SQL.replace("{p}", rf"\b({_NAMES_SQL})\s+\((\d{{4}})[a-z]?\)")
    + "))) AS INTEGER)"
)
_BODY_SQL = f"substring(content, 1, length(content) - coalesce(length({_SECTION_SQL}), 0))"


@query(f"SELECT doc_id, {_INLINE_SQL.replace('{t}', 'body')} AS n_inline FROM (SELECT doc_id, {_BODY_SQL} AS body FROM md)")
def inline_citations(spark: SparkSession, d: str) -> DataFrame:
    return ad.markdown(spark, d).select("doc_id", tx.inline_citations(tx.body(F.col("content"))).alias("n_inline"))


@query(f"SELECT doc_id, found AND n >= 10 AND 1 < 0.5 * n AS undercounted FROM (SELECT doc_id, {_SECTION_SQL} IS NOT NULL AS found, {_INLINE_SQL.replace('{t}', '(' + _BODY_SQL + ')')} + CAST(doc_id % 12 AS INTEGER) AS n FROM md)")
def undercount_flag(spark: SparkSession, d: str) -> DataFrame:
    section = tx.reference_section(F.col("content"))
    n = tx.inline_citations(tx.body(F.col("content"))) + F.pmod("doc_id", F.lit(12)).cast("int")
    return ad.markdown(spark, d).select("doc_id", tx.undercounted(section.isNotNull(), n, F.lit(1)).alias("undercounted"))


_COST = f"SELECT source_file, CAST(ceil((least(length(content), 12000) + 560) / 4.0) AS BIGINT) AS metadata_tokens, CAST(ceil((length(coalesce({_SECTION_SQL}, content)) + 1060) / 4.0) AS BIGINT) AS reference_tokens, CAST(greatest(1, length(coalesce({_SECTION_SQL}, content)) // 175) AS BIGINT) AS \"references\", {_SECTION_SQL} IS NOT NULL AS has_section FROM md"
_TOTALS = f"SELECT count(*) FILTER (metadata_tokens > 0) AS n_metadata, count(*) FILTER (reference_tokens > 0) AS n_references, CAST(sum(metadata_tokens + reference_tokens) AS BIGINT) AS input_tokens, CAST(sum(\"references\") AS BIGINT) AS estimated_references, CAST(300 * count(*) FILTER (metadata_tokens > 0) + 75 * sum(\"references\") AS BIGINT) AS output_tokens FROM ({_COST})"


@query(_COST)
def cost_per_file(spark: SparkSession, d: str) -> DataFrame:
    return pl.estimate(ad.markdown(spark, d))


@query(_TOTALS)
def cost_summary(spark: SparkSession, d: str) -> DataFrame:
    return pl.estimate_totals(pl.estimate(ad.markdown(spark, d)))


@query(f"SELECT model, round((input_tokens * pin + output_tokens * pout) / 1e6, 6) AS usd FROM (VALUES ('small', 0.10, 0.40), ('large', 1.25, 10.00), ('none', NULL, NULL)) v(model, pin, pout), ({_TOTALS})".replace("0.10, 0.40", "CAST(0.10 AS DOUBLE), CAST(0.40 AS DOUBLE)").replace("1.25, 10.00", "CAST(1.25 AS DOUBLE), CAST(10.00 AS DOUBLE)"))
def cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    return pl.cost(pl.estimate_totals(pl.estimate(ad.markdown(spark, d))), ["small", "large", "none"]).withColumn("usd", F.round("usd", 6))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '[^a-zA-Z0-9\\s]', '', 'g')) AS normal FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "documents").select("doc_id", F.md5(tx.normalized(F.col("text"))).alias("normal"))


@query("SELECT doc_id, substring(text, 1, 12000) AS head FROM documents")
def metadata_input(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "documents").select("doc_id", tx.metadata_input(F.col("text")).alias("head"))


_NORMAL = "regexp_replace(regexp_replace(lower({c}), '^\\s+|\\s+$', '', 'g'), '[^a-zA-Z0-9\\s]', '', 'g')"
_AUTHOR_KEY = "coalesce(nullif(lower(regexp_replace(split_part(Authors, ',', 1), '[^\\p{L}]', '', 'g')), ''), 'unknown')"
_TITLE_KEY = "array_to_string(list_filter(regexp_split_to_array(" + _NORMAL.replace("{c}", "Title") + ", '\\s+'), lambda x: x <> '')[1:6], ' ')"


@query(f"SELECT ord, {_AUTHOR_KEY} AS author_key, {_TITLE_KEY} AS title_key FROM raw_refs")
def block_keys(spark: SparkSession, d: str) -> DataFrame:
    return dd.keyed(ad.raw_references(spark, d)).select("ord", "author_key", "title_key")


_SLUG = "regexp_replace(regexp_replace(lower(strip_accents(Title)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"SELECT ord, concat_ws('-', 'r', {_AUTHOR_KEY}, CAST(Year AS VARCHAR), coalesce(nullif(coalesce(nullif(regexp_extract({_SLUG} || '-', '^(.{{1,40}})-', 1), ''), regexp_replace(substring({_SLUG}, 1, 40), '-$', '')), ''), 'untitled')) AS id FROM raw_refs")
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    return ad.raw_references(spark, d).select("ord", tx.record_id("r", F.col("Authors"), F.col("Year"), F.col("Title"), F.col("Authors_List")).alias("id"))


@query("SELECT event_id, json_extract_string(fixed, '$[0].k') AS k FROM (SELECT event_id, regexp_extract(cut, '(?s)\\A(.*\\})', 1) || chr(10) || ']' AS fixed FROM (SELECT event_id, '[{\"k\": \"' || event_type || '\"}, {\"k\": \"' || substring(event_type, 1, 2) AS cut FROM events))")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    broken = F.concat(F.lit('[{"k": "'), "event_type", F.lit('"}, {"k": "'), F.substring("event_type", 1, 2))
    return ad.table(spark, d, "events").select("event_id", tx.structured(tx.repaired_json(broken), "array<struct<k:string>>")[0]["k"].alias("k"))


@query("SELECT conv_id, bool_or(contains(upper(role) || '_MAX_TOKENS', 'TOOL_MAX_TOKENS')) AS cut_off FROM conversations GROUP BY conv_id")
def truncated_responses(spark: SparkSession, d: str) -> DataFrame:
    reasons = F.collect_list(F.when(F.upper("role") == "TOOL", F.lit("FinishReason.MAX_TOKENS")).otherwise(F.lit("STOP")))
    return ad.table(spark, d, "conversations").groupBy("conv_id").agg(reasons.alias("r")).select("conv_id", tx.truncated(F.col("r")).alias("cut_off"))


@query("SELECT page_id, regexp_replace(array_to_string(string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '\\.[^./]*$', ''), '/'), '__'), '[ \\\\:]', '_', 'g') AS stem FROM pages")
def cache_stems(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "pages").select("page_id", files.cache_stem(F.regexp_replace("url", "^https?://", "")).alias("stem"))


@query("SELECT source || '_' || lang AS stem, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def stem_collisions(spark: SparkSession, d: str) -> DataFrame:
    named = ad.table(spark, d, "documents").select(F.concat("source", F.lit(":"), "lang", F.lit(".pdf")).alias("relative"))
    return files.stem_collisions(named).select("stem", "n")


@query("SELECT lang, term, sum(len(regexp_extract_all(lower(text), '(?:^|[^a-z])' || term))) AS n FROM documents, (VALUES ('the'), ('and'), ('die'), ('les')) v(term) GROUP BY ALL".replace("sum(len(", "CAST(sum(len(").replace("term)))", "term))) AS BIGINT)"))
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_counts(ad.table(spark, d, "documents"), {"": ["the", "and", "die", "les"]})


# Deduplication

_CANDIDATES = f"k AS (SELECT ord, Year, {_AUTHOR_KEY} AS a, {_TITLE_KEY} AS t FROM raw_refs) SELECT x.ord AS i, y.ord AS j FROM k x JOIN k y ON x.ord < y.ord AND abs(x.Year - y.Year) <= 1 AND (x.a = y.a OR y.a = 'unknown' OR (x.t = y.t AND x.t <> ''))"


@query("WITH " + _CANDIDATES)
def dedup_candidates(spark: SparkSession, d: str) -> DataFrame:
    return dd.candidates(dd.keyed(ad.raw_references(spark, d)))


@query()
def fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dd.scored(files.cut(dd.sides(dd.keyed(ad.raw_references(spark, d)))))


@query(
    "WITH RECURSIVE pr AS (SELECT p_partkey AS id, p_name AS a, p_type AS b FROM part),"
    " dp(id, a, b, i, v) AS (SELECT id, a, b, 0, list_transform(range(0, length(b) + 1), lambda z: 0) FROM pr"
    " UNION ALL SELECT id, a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, CASE WHEN a[i + 1] = b[j] THEN v[j] + 1 ELSE greatest(v[j + 1], acc[len(acc)]) END), CAST([0] AS INTEGER[])) FROM dp WHERE i < length(a))"
    " SELECT id, a, b, round(200.0 * v[len(v)] / (length(a) + length(b)), 6) AS score FROM dp WHERE i = length(a)".replace("range(1, length(b) + 1), lambda", "list_transform(range(1, length(b) + 1), lambda q: CAST(q AS INTEGER)), lambda")
)
def ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = ad.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    return pairs.select("id", "a", "b", F.round(similarity.ratio_of("a", "b"), 6).alias("score"))


@query()
def dedup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return dd.cluster(ad.raw_references(spark, d))


@query()
def dedup_edges(spark: SparkSession, d: str) -> DataFrame:
    records = ad.raw_references(spark, d)
    return dd.citation_edges(records, dd.canonical(records, dd.cluster(records))[1])


@query()
def dedup_references(spark: SparkSession, d: str) -> DataFrame:
    records = ad.raw_references(spark, d)
    return dd.canonical(records, dd.cluster(records))[0].drop("Authors_List")


@query()
def source_duplicates(spark: SparkSession, d: str) -> DataFrame:
    papers = ad.papers(spark, d).withColumns({"ord": F.substring("id", 3, 20).cast("long"), "Authors": F.col("Title"), "source_file": F.concat("id", F.lit(".md"))})
    return dd.source_duplicates(papers).withColumn("duplicate_source_files", joined(F.col("duplicate_source_files")))


@query("SELECT id, ord FROM (SELECT Journal || '-' || Year AS id, ord, row_number() OVER (PARTITION BY Journal || '-' || Year ORDER BY ord) AS n FROM raw_refs) WHERE n = 1")
def papers_first_by_id(spark: SparkSession, d: str) -> DataFrame:
    return dd.first_by_id(ad.raw_references(spark, d).select(F.concat_ws("-", "Journal", F.col("Year").cast("string")).alias("id"), "ord"))


@query("SELECT id FROM papers WHERE id NOT IN (SELECT citing_id FROM edges)")
def papers_without_refs(spark: SparkSession, d: str) -> DataFrame:
    return dd.without_references(ad.papers(spark, d), ad.edges(spark, d)).select("id")


# Authors

def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    return au.occurrences(ad.raw_references(spark, d).withColumns({"id": F.concat(F.lit("r-"), F.col("ord").cast("string")), "citing_paper_id": F.col("citing_id")}), "reference")


@query()
def parse_authors(spark: SparkSession, d: str) -> DataFrame:
    p = au.parsed("Authors").alias("p")
    return ad.raw_references(spark, d).select("ord", p).select("ord", "p.surname", "p.surname_norm", "p.initials", "p.full_first")


@query()
def author_clusters_strict(spark: SparkSession, d: str) -> DataFrame:
    return au.clustered(_occurrences(spark, d)).select("ord", "record_id", "surname_norm", "cluster", "rank")


@query()
def author_clusters_loose(spark: SparkSession, d: str) -> DataFrame:
    return au.clustered(_occurrences(spark, d), "loose").groupBy("surname_norm", F.substring("initials", 1, 1).alias("initial")).agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("clusters"))


@query()
def author_ids(spark: SparkSession, d: str) -> DataFrame:
    return au.authors_table(files.cut(au.clustered(_occurrences(spark, d))))[0]


@query()
def author_review(spark: SparkSession, d: str) -> DataFrame:
    table, cites = au.authors_table(files.cut(au.clustered(_occurrences(spark, d))))
    return au.review(table, cites).withColumn("raw_strings", joined(F.col("raw_strings")))


@query("WITH RECURSIVE al AS (SELECT 'a-' || s_suppkey AS f, 'a-' || (s_suppkey // 2) AS t FROM supplier WHERE s_suppkey // 2 >= 1), up(f, t) AS (SELECT f, t FROM al UNION ALL SELECT up.f, al.t FROM up JOIN al ON al.f = up.t) SELECT f AS cluster_id, t AS canonical_id FROM up WHERE t NOT IN (SELECT f FROM al)")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    half = F.floor(F.col("s_suppkey") / 2).cast("long")
    pairs = ad.table(spark, d, "supplier").where(half >= 1).select(F.concat(F.lit("a-"), F.col("s_suppkey").cast("string")).alias("cluster_id"), F.concat(F.lit("a-"), half.cast("string")).alias("canonical_id"))
    return au.resolve_aliases(pairs)


# Enrichment and evaluation

def _catalogues(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    refs = ad.references(spark, d)
    n = F.substring("id", 3, 12).cast("long")
    title = F.when(F.pmod(n, F.lit(5)) == 0, F.upper("Title")).when(F.pmod(n, F.lit(5)) == 1, F.reverse("Title")).otherwise(F.concat("Title", F.lit("s")))
    year = F.col("Year") + F.pmod(n, F.lit(3)).cast("int")
    some = lambda k: refs.where(F.pmod(n, F.lit(k)) > 0).select(F.col("id").alias("ref_id"), F.lit(0).alias("pos"), title.alias("title"), year.cast("int").alias("year"), F.concat(F.lit("10.1/"), "id").alias("doi"))
    return refs, some(4), some(7)


# Ratios by the same recursion as ratio_pairs; both catalogues offer one candidate a reference, so one score serves both.
_SCORED = (
    "WITH RECURSIVE pr AS (SELECT id, n, Year, c, lower(Title) AS a, lower(c) AS b FROM (SELECT id, CAST(substring(id, 3) AS BIGINT) AS n, Title, Year,"
    " CASE CAST(substring(id, 3) AS BIGINT) % 5 WHEN 0 THEN upper(Title) WHEN 1 THEN reverse(Title) ELSE Title || 's' END AS c FROM refs)),"
    " dp(id, a, b, i, v) AS (SELECT id, a, b, 0, list_transform(range(0, length(b) + 1), lambda z: 0) FROM pr"
    " UNION ALL SELECT id, a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda q: CAST(q AS INTEGER)), lambda acc, j: list_append(acc, CASE WHEN a[i + 1] = b[j] THEN v[j] + 1 ELSE greatest(v[j + 1], acc[len(acc)]) END), CAST([0] AS INTEGER[])) FROM dp WHERE i < length(a)),"
    " sc AS (SELECT id, 200.0 * CAST(v[len(v)] AS DOUBLE) / (length(a) + length(b)) AS s FROM dp WHERE i = length(a)),"
    " cand AS (SELECT id, n, c, s, CAST(n % 3 AS INTEGER) AS delta, s - CASE WHEN n % 3 > 0 THEN 8.0 ELSE 0.0 END AS adj FROM pr JOIN sc USING (id)),"
    " why AS (SELECT *, CASE WHEN adj <= 0 THEN NULL WHEN adj >= 90 THEN 'ok' WHEN s >= 90 AND delta > 0 THEN 'year_mismatch' ELSE 'below_title_threshold' END AS w FROM cand),"
    " ab AS (SELECT *, CASE WHEN n % 4 = 0 OR w IS NULL THEN 'no_crossref_candidates' ELSE w END AS ra, CASE WHEN n % 7 = 0 OR w IS NULL THEN 'no_openalex_candidates' ELSE w END AS rb FROM why)"
)
# Of two misses the graver one; of equally grave ones a lack of candidates in the second catalogue.
_TOLD = "CASE WHEN ra = 'no_crossref_candidates' THEN rb ELSE ra END"


@query(_SCORED + " SELECT id, CASE WHEN ra <> 'no_crossref_candidates' THEN c END AS candidate_title, CASE WHEN ra <> 'no_crossref_candidates' THEN round(s, 6) END AS title_score, CASE WHEN ra <> 'no_crossref_candidates' THEN round(adj, 6) END AS adjusted_score, CASE WHEN ra <> 'no_crossref_candidates' THEN delta = 0 END AS year_match, CASE WHEN ra <> 'no_crossref_candidates' THEN delta END AS year_delta, nullif(ra, 'ok') AS miss_reason FROM ab")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    refs, first, _ = _catalogues(spark, d)
    return en.best_candidate(refs, first, "crossref").select("id", "candidate_title", F.round("title_score", 6).alias("title_score"), F.round("adjusted_score", 6).alias("adjusted_score"), "year_match", "year_delta", "miss_reason")


@query(_SCORED + f" SELECT id, {_TOLD} AS enrichment_miss_reason FROM ab WHERE ra <> 'ok' AND rb <> 'ok'")
def miss_reason(spark: SparkSession, d: str) -> DataFrame:
    return en.misses(en.enriched(*_catalogues(spark, d))).select("id", "enrichment_miss_reason")


@query(_SCORED + " SELECT source, count(*) AS n, count(*) / sum(count(*)) OVER () AS rate FROM (SELECT CASE WHEN ra = 'ok' THEN 'crossref' WHEN rb = 'ok' THEN 'openalex' ELSE 'miss' END AS source FROM ab) GROUP BY source")
def enrich_summary(spark: SparkSession, d: str) -> DataFrame:
    return en.by_source(en.enriched(*_catalogues(spark, d)))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    r = ad.raw_references(spark, d)
    sur = F.filter(F.split(F.lower("Title"), "[^a-z]+"), lambda x: x != "")
    return r.select("ord", "citing_id", F.col("Title").alias("gold_Title"), F.when(F.pmod("ord", F.lit(4)) == 0, F.reverse("Title")).otherwise(F.upper("Title")).alias("pred_Title"), F.col("Journal").alias("gold_Journal"), F.col("Journal").alias("pred_Journal"), F.col("Year").alias("gold_Year"), (F.col("Year") + F.pmod("ord", F.lit(2)).cast("int")).alias("pred_Year"), F.array_distinct(sur).alias("gold_Surnames"), F.array_distinct(F.slice(sur, 1, 3)).alias("pred_Surnames"))


@query()
def eval_metadata(spark: SparkSession, d: str) -> DataFrame:
    return ev.metadata_report(_gold(spark, d))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(Title), '[^a-z]+'), lambda x: x <> ''))"
_FIRST3 = "list_distinct(list_filter(regexp_split_to_array(lower(Title), '[^a-z]+'), lambda x: x <> '')[1:3])"


@query(f"SELECT ord, round(CASE WHEN len({_WORDS}) = 0 THEN 1.0 ELSE len({_FIRST3}) / len({_WORDS}) END, 9) AS jaccard FROM raw_refs".replace("1.0 ELSE", "CAST(1 AS DOUBLE) ELSE"))
def eval_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).select("ord", F.round(ev.jaccard(F.col("gold_Surnames"), F.col("pred_Surnames")), 9).alias("jaccard"))


@query()
def eval_references(spark: SparkSession, d: str) -> DataFrame:
    g = _gold(spark, d)
    both = g.select(F.col("citing_id").alias("paper_id"), F.lit("gold").alias("side"), "ord", F.col("gold_Title").alias("Title")).unionByName(g.select(F.col("citing_id").alias("paper_id"), F.lit("pred").alias("side"), "ord", F.col("pred_Title").alias("Title")))
    return ev.precision_recall(ev.reference_matches(both))


@query()
def eval_dedup(spark: SparkSession, d: str) -> DataFrame:
    records = ad.raw_references(spark, d)
    w = Window.partitionBy("Title").orderBy("ord")
    pairs = records.where("Title <> ''").select(F.lag("ord").over(w).alias("i"), F.col("ord").alias("j")).where("i IS NOT NULL")
    return ev.dedup_share(pairs, dd.cluster(records))
