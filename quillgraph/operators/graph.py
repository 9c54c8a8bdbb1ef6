"""The citation graph: five tables and the questions asked of them. Every method is one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import unaccented
from ..sources import schema
from ..sources.files import Layout, exists, read_table


@dataclass(frozen=True)
class Graph:
    papers: DataFrame
    references: DataFrame
    edges: DataFrame
    authors: DataFrame | None = None
    author_citations: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Graph:
        """From an output folder; the author tables may be absent, any other absence is an error that names all of them."""
        at = Layout(folder)
        absent = [at.at(n) for n in ("papers", "canonical", "graph") if not exists(spark, at.at(n))]
        if absent:
            raise FileNotFoundError(f"not found: {', '.join(absent)}")
        get = lambda n, kind: read_table(spark, at.at(n), kind)
        more = exists(spark, at.at("authors")) and exists(spark, at.at("author_citations"))
        return cls(get("papers", schema.PAPERS), get("canonical", schema.REFERENCES), get("graph", schema.EDGES), get("authors", schema.AUTHORS) if more else None, get("author_citations", schema.AUTHOR_CITATIONS) if more else None)

    @classmethod
    def of(cls, result) -> Graph:
        """From what a pipeline's run returned."""
        return cls(result.papers, result.references, result.graph, result.authors, result.author_citations)

    def __repr__(self) -> str:
        c = self.counts().first()
        return f"Graph({c['n_papers']} papers, {c['n_references']} references, {c['n_edges']} edges)"

    def counts(self) -> DataFrame:
        one = [df.agg(F.count("*").alias(n)) for n, df in (("n_papers", self.papers), ("n_references", self.references), ("n_edges", self.edges))]
        return one[0].crossJoin(one[1]).crossJoin(one[2])

    @property
    def has_authors(self) -> bool:
        return self.authors is not None and self.author_citations is not None

    def _need_authors(self) -> None:
        if not self.has_authors:
            raise RuntimeError("author tables are needed; run the author stage first")

    def cited_by(self, paper_id: str) -> DataFrame:
        """References that a paper cites."""
        hit = self.edges.where(F.col("citing_id") == paper_id)
        return self.references.join(hit, self.references["id"] == hit["cited_id"], "left_semi")

    def citers_of(self, reference_id: str) -> DataFrame:
        hit = self.edges.where(F.col("cited_id") == reference_id)
        return self.papers.join(hit, self.papers["id"] == hit["citing_id"], "left_semi")

    def top_cited(self, n: int = 20) -> DataFrame:
        """The n most cited ids, where they are references; ties by id."""
        top = self.edges.groupBy(F.col("cited_id").alias("id")).agg(F.count("*").alias("n_citations")).orderBy(F.desc("n_citations"), "id").limit(n)
        return self.references.join(top, "id").orderBy(F.desc("n_citations"), "id")

    def top_cited_authors(self, n: int = 20) -> DataFrame:
        self._need_authors()
        return self.authors.orderBy(F.desc("n_reference_citations"), "id").limit(n)

    def find_author(self, query: str) -> DataFrame:
        """Authors whose name has the query in it, literally, whatever case and accents."""
        self._need_authors()
        if not query.strip():
            return self.authors.limit(0)
        fold = lambda c: F.lower(unaccented(c))
        wanted = fold(F.lit(query.strip()))
        return self.authors.where(F.contains(fold(F.col("surname_norm")), wanted) | F.contains(fold(F.col("display_name")), wanted))

    def _of(self, author_id: str) -> DataFrame:
        self._need_authors()
        return self.author_citations.where((F.col("author_id") == author_id) & (F.col("record_kind") == "reference"))

    def citation_context(self, author_id: str) -> DataFrame:
        """Each citation of the author's works, with both sides' fields."""
        return self._context(author_id).orderBy("citing_id", "cited_id", "position")

    def _context(self, author_id: str) -> DataFrame:
        mine = self._of(author_id).select(F.col("record_id").alias("cited_id"), "author_id", "position", "raw_author")
        column = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
        side = lambda df, key, p: df.select(F.col("id").alias(key), *[column(df, c).alias(f"{p}_{c.lower()}") for c in ("Title", "Journal", "Year")])
        joined = self.edges.join(mine, "cited_id").join(side(self.papers, "citing_id", "citing"), "citing_id", "left").join(side(self.references, "cited_id", "cited"), "cited_id", "left")
        if "display_name" in self.authors.columns:
            name = self.authors.where(F.col("id") == author_id).select(F.col("id").alias("author_id"), F.col("display_name").alias("author_display_name"))
            joined = joined.join(name, "author_id", "left")
        else:
            joined = joined.withColumn("author_display_name", F.lit(""))
        return joined.select("author_id", F.coalesce("author_display_name", F.lit("")).alias("author_display_name"), "citing_id", "citing_title", "citing_journal", "citing_year", "cited_id", "cited_title", "cited_journal", "cited_year", "position", "raw_author")

    def citations_of(self, author_id: str) -> DataFrame:
        """The author's works with the ids of the papers that cite them."""
        mine = self._of(author_id).select(F.col("record_id").alias("cited_id")).distinct()
        who = self.edges.join(mine, "cited_id").groupBy("cited_id").agg(F.array_sort(F.collect_set("citing_id")).alias("citing_ids"))
        return self.references.join(who, self.references["id"] == who["cited_id"]).drop("cited_id").withColumn("n_citing", F.size("citing_ids"))

    def papers_citing_author(self, author_id: str) -> DataFrame:
        hit = self.edges.join(self._of(author_id).select(F.col("record_id").alias("cited_id")).distinct(), "cited_id", "left_semi")
        return self.papers.join(hit, self.papers["id"] == hit["citing_id"], "left_semi")

    def citing_papers_by_author(self, author_id: str) -> DataFrame:
        """A row a citing paper: which of the author's works it cites."""
        rows = self._context(author_id)
        titles = F.transform(F.array_sort(F.collect_list(F.struct("cited_id", "position", "cited_title"))), lambda s: s["cited_title"])
        out = rows.groupBy(F.col("citing_id").alias("paper_id"), F.col("citing_title").alias("Title"), F.col("citing_journal").alias("Journal"), F.col("citing_year").alias("Year")).agg(F.countDistinct("cited_id").alias("n_references"), F.array_sort(F.collect_set("cited_id")).alias("cited_ids"), F.array_distinct(F.filter(titles, lambda t: t.isNotNull())).alias("cited_titles"))
        return out.orderBy(F.desc("n_references"), "paper_id")

    def source_journals_citing_author(self, author_id: str) -> DataFrame:
        rows = self._context(author_id).select("citing_id", "citing_journal").distinct()
        n = rows.groupBy(F.coalesce(F.nullif("citing_journal", F.lit("")), F.lit("(unknown)")).alias("journal")).agg(F.count("*").alias("n_papers"))
        return n.withColumn("share", F.col("n_papers") / F.sum("n_papers").over(Window.partitionBy())).orderBy(F.desc("n_papers"), "journal")

    def vertices(self) -> DataFrame:
        both = self.papers.select("id", F.lit("paper").alias("kind")).unionByName(self.references.select("id", F.lit("reference").alias("kind")))
        return both.groupBy("id").agg(F.max("kind").alias("kind"))

    def links(self) -> DataFrame:
        return self.edges.select(F.col("citing_id").alias("src"), F.col("cited_id").alias("dst")).distinct()


def joined(ids: Column) -> Column:
    return F.array_join(ids, "|")
