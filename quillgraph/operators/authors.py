"""Author entity resolution: one row for each author of each record, clustered within surname blocks.

Loose clusters are a groupBy. Strict clusters depend on order and run in one pandas group a surname block, the
occurrences sorted by their ordinal; a block is as large as the most frequent surname.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from ..functions import names
from ..functions import text as tx
from ..sources.files import cut, numbered

_OCCURRENCE = (
    "ord long, record_kind string, record_id string, position int, citing_paper_id string, raw_author string, surname string, surname_norm string, "
    "given array<string>, initials string, full_first boolean, first_norm string, co_keys array<string>, openalex_id string, orcid string"
)
_FIELDS = [c.split()[0] for c in _OCCURRENCE.split(", ")]


_NAME = T.StructType([T.StructField(c, T.ArrayType(T.StringType()) if c == "given" else T.BooleanType() if c == "full_first" else T.StringType()) for c in names.Name._fields])


@F.pandas_udf(_NAME)
def parsed(raw: pd.Series) -> pd.DataFrame:
    rows = [names.parse(x) for x in raw]
    return pd.DataFrame([tuple(r) if r else (None,) * 7 for r in rows], columns=list(names.Name._fields))


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_names(joined: pd.Series) -> pd.Series:
    return joined.map(names.split_joined)


def occurrences(records: DataFrame, kind: str) -> DataFrame:
    """One row for each author that can be parsed. records: ord, id, Authors_List and/or Authors, maybe citing_paper_id and
    OpenAlex_Authors. Co-authors are the other parsed authors of the record."""
    have = set(records.columns)
    take = records.select(
        "ord",
        F.col("id").alias("record_id"),
        (F.col("Authors_List") if "Authors_List" in have else F.lit(None).cast("array<string>")).alias("listed"),
        (F.col("Authors") if "Authors" in have else F.lit(None).cast("string")).alias("joined"),
        (F.col("citing_paper_id") if "citing_paper_id" in have else F.lit(None).cast("string")).alias("citing"),
        (F.col("OpenAlex_Authors") if "OpenAlex_Authors" in have else F.lit(None).cast("array<struct<display_name:string,openalex_id:string,orcid:string>>")).alias("known"),
    )

    def each(batches):
        for pdf in batches:
            rows = []
            for ord_, rid, listed, joined, citing, known in zip(pdf.ord, pdf.record_id, pdf.listed, pdf.joined, pdf.citing, pdf.known, strict=True):
                found = [(k, n) for k, n in enumerate(map(names.parse, names.row_names(listed, joined))) if n]
                known = list(known) if known is not None else []
                for at, (k, n) in enumerate(found):
                    match = {}
                    if known and len(known) == len(found):
                        match = known[at] or {}
                    elif known:
                        match = next((x for x in known if x and (c := names.parse(x["display_name"])) and c.surname_norm == n.surname_norm), {})
                    others = sorted({m.surname_norm for j, (_, m) in enumerate(found) if j != at})
                    rows.append(((ord_ << 17) + k, kind, rid, k, citing, n.raw, n.surname, n.surname_norm, n.given, n.initials, n.full_first, n.first_norm, others, match.get("openalex_id"), match.get("orcid")))
            yield pd.DataFrame(rows, columns=_FIELDS)

    return take.mapInPandas(each, _OCCURRENCE)


def _keys(cluster: list[dict]) -> set[str]:
    return {k for o in cluster for k in o["co_keys"]}


def strict_block(rows: list[dict]) -> list[list[dict]]:
    """Clusters of one surname block, precision first."""
    outside: dict[str, list[dict]] = defaultdict(list)
    anchors: dict[str, list[dict]] = defaultdict(list)
    short = []
    for o in rows:
        key = o["openalex_id"] or o["orcid"]
        if key:
            outside[key].append(o)
        elif o["full_first"]:
            anchors[o["first_norm"]].append(o)
        else:
            short.append(o)
    loose: dict[str, list[dict]] = defaultdict(list)
    for o in short:
        first = o["initials"][:1].lower()
        homes = [a for a in anchors if a.startswith(first)] if first else []
        if len(homes) > 1:
            homes = [a for a in homes if _keys(anchors[a]) & set(o["co_keys"])]
        if len(homes) == 1:
            anchors[homes[0]].append(o)
        else:
            loose[o["initials"].lower()].append(o)
    known = list(outside.values())
    out = list(known)
    for cluster in [*anchors.values(), *loose.values()]:
        full = {o["first_norm"] for o in cluster if o["full_first"] and o["first_norm"]}
        mine = full or {o["initials"][:1].lower() for o in cluster if o["initials"]}
        theirs = (lambda c: {o["first_norm"] for o in c if o["full_first"] and o["first_norm"]}) if full else (lambda c: {o["initials"][:1].lower() for o in c if o["initials"]})
        fitting = [c for c in known if mine & theirs(c)]
        if len(fitting) > 1:
            fitting = [c for c in fitting if _keys(c) & _keys(cluster)]
        if len(fitting) == 1:
            fitting[0].extend(cluster)
        else:
            out.append(cluster)
    return out


def clustered(occ: DataFrame, mode: str = "strict") -> DataFrame:
    """Occurrences with ``cluster`` (surname block and the least ordinal in it) and ``rank`` of the cluster in its block."""
    if mode == "loose":
        w = Window.partitionBy("surname_norm", F.substring("initials", 1, 1))
        out = occ.withColumn("head", F.min("ord").over(w))
        return out.withColumn("rank", F.dense_rank().over(Window.partitionBy("surname_norm").orderBy("head")).cast("int")).withColumn("cluster", F.concat_ws("#", "surname_norm", F.col("head").cast("string"))).drop("head")
    if mode != "strict":
        raise ValueError(f"unknown merge mode {mode!r}")

    def block(rows: list[dict]) -> list[dict]:
        for o in rows:
            o["openalex_id"], o["orcid"] = o["openalex_id"] or None, o["orcid"] or None
        made = []
        for k, cluster in enumerate(strict_block(rows)):
            name = f"{rows[0]['surname_norm']}#{min(o['ord'] for o in cluster)}"
            made += [{**o, "cluster": name, "rank": k + 1, "seat": s} for s, o in enumerate(cluster)]
        return made

    def blocks(batches):
        """Surname blocks stand one after another in a partition, so a task holds one of them and some finished rows."""
        rows: list[dict] = []
        made: list[dict] = []
        for batch in batches:
            for o in batch.to_pylist():
                if rows and o["surname_norm"] != rows[0]["surname_norm"]:
                    made += block(rows)
                    rows = []
                rows.append(o)
            if len(made) >= 4000:
                yield pa.RecordBatch.from_pylist(made, wanted)
                made = []
        made += block(rows) if rows else []
        if made:
            yield pa.RecordBatch.from_pylist(made, wanted)

    kinds = f"{_OCCURRENCE}, rank int, cluster string, seat int"
    wanted = to_arrow_schema(occ.sparkSession.createDataFrame([], kinds).schema)
    return occ.select(*_FIELDS).repartition("surname_norm").sortWithinPartitions("surname_norm", "ord").mapInArrow(blocks, kinds)


def authors_table(members: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(authors, author_citations) of clustered occurrences."""
    seat = F.col("seat") if "seat" in members.columns else F.col("ord")
    members = members.withColumn("seat", seat.cast("long"))
    full = F.when(F.col("full_first") & (F.size("given") > 0), F.col("given")[0])
    longest = lambda c: F.max_by(c, F.struct(F.length(c), -F.col("seat")))  # noqa: E731 - the first of the longest
    own = members.groupBy("surname_norm", "cluster", "rank").agg(
        longest(full).alias("full"),
        longest(F.col("initials")).alias("inits"),
        F.coalesce(F.min_by(F.when(F.regexp_like("surname", F.lit(r"\p{Lu}")), F.col("surname")), F.when(F.regexp_like("surname", F.lit(r"\p{Lu}")), F.col("seat"))), F.min_by("surname", "seat")).alias("surname"),
        F.min_by("openalex_id", F.when(F.col("openalex_id").isNotNull(), F.col("seat"))).alias("openalex_id"),
        F.min_by("orcid", F.when(F.col("orcid").isNotNull(), F.col("seat"))).alias("orcid"),
        F.count("*").alias("n_occurrences"),
        F.count_if(F.col("record_kind") == "reference").alias("n_reference_citations"),
    )
    given = F.coalesce("full", "inits", F.lit(""))
    token = F.when(F.col("full").isNotNull(), F.regexp_replace(F.lower(tx.unaccented(F.col("full"))), r"^[.\-]+|[.\-]+$", "")).otherwise(F.lower("inits"))
    base = F.concat(F.lit("a-"), F.coalesce(F.nullif(tx.slug(F.col("surname_norm")), F.lit("")), F.lit("unknown")), F.lit("-"), F.coalesce(F.nullif(tx.slug(F.coalesce(token, F.lit(""))), F.lit("")), F.lit("x")))
    named = own.withColumns({"base": base, "canonical_given": given})
    nth = F.row_number().over(Window.partitionBy("base").orderBy("surname_norm", "rank"))
    named = named.withColumn("id", F.when(nth == 1, F.col("base")).otherwise(F.concat_ws("-", "base", (nth - 1).cast("string"))))
    shouted = F.col("canonical_given").rlike(r"\p{L}") & (F.upper("canonical_given") == F.col("canonical_given"))
    named = named.withColumn("display_name", F.when(F.col("canonical_given") == "", F.col("surname")).when(shouted, F.concat(F.col("surname"), F.lit(", "), F.col("canonical_given"))).otherwise(F.concat_ws(" ", "canonical_given", "surname")))
    listed = members.join(named.select("cluster", F.col("id").alias("author_id")), "cluster")
    citations = listed.select("author_id", "record_kind", "record_id", "position", F.coalesce("citing_paper_id", F.lit("")).alias("citing_paper_id"), "raw_author")
    if edges is None:
        papers = listed.groupBy("author_id").agg(F.countDistinct(F.when(F.col("record_kind") == "reference", F.col("citing_paper_id"))).alias("n_distinct_papers_citing"))
    else:
        papers = citations.where("record_kind = 'reference'").select("author_id", F.col("record_id").alias("cited_id")).distinct().join(edges, "cited_id").groupBy("author_id").agg(F.countDistinct("citing_id").alias("n_distinct_papers_citing"))
    table = named.withColumn("initials", F.coalesce("inits", F.lit(""))).join(papers.withColumnRenamed("author_id", "id"), "id", "left")
    columns = ["id", "display_name", "surname", "surname_norm", "canonical_given", "initials", "openalex_id", "orcid", "n_occurrences", "n_reference_citations"]
    return table.select(*columns, F.coalesce("n_distinct_papers_citing", F.lit(0)).alias("n_distinct_papers_citing")).orderBy(F.desc("n_reference_citations"), "id"), citations


def review(authors: DataFrame, citations: DataFrame, least: int = 3) -> DataFrame:
    """Clusters worth a look: no outside id, initials only, several occurrences."""
    raw = citations.groupBy(F.col("author_id").alias("id")).agg(F.array_sort(F.collect_set("raw_author")).alias("raw_strings"))
    doubtful = authors.where(F.col("openalex_id").isNull() & F.col("orcid").isNull() & (F.lower("canonical_given") == F.lower("initials")) & (F.col("n_occurrences") >= least))
    return doubtful.join(raw, "id").select(F.col("id").alias("author_id"), "display_name", "surname", "n_occurrences", "raw_strings", F.lit("initials only, no external id").alias("reason"))


def resolve_aliases(aliases: DataFrame, rounds: int = 30) -> DataFrame:
    """(cluster_id, canonical_id) with chains followed to their ends; members of a cycle keep their ids. Each round
    doubles the reach, so ``rounds`` bounds chains of 2**rounds."""
    step = aliases.where("cluster_id <> canonical_id").select("cluster_id", "canonical_id")
    for _ in range(rounds):
        nxt = step.select(F.col("cluster_id").alias("canonical_id"), F.col("canonical_id").alias("to"))
        step = cut(step.join(nxt, "canonical_id", "left").select("cluster_id", F.coalesce("to", "canonical_id").alias("new"), F.col("to").isNotNull().alias("moved")))
        done = step.where("moved AND cluster_id <> new").isEmpty()
        step = step.select("cluster_id", F.col("new").alias("canonical_id"))
        if done:
            break
    heads = aliases.where("cluster_id <> canonical_id").select(F.col("cluster_id").alias("canonical_id"))
    return step.join(heads, "canonical_id", "left_anti").where("cluster_id <> canonical_id").select("cluster_id", "canonical_id")


def apply_aliases(authors: DataFrame, citations: DataFrame, aliases: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables after merging. Ids unknown to ``authors`` are left out; display names stay, outside ids are taken over."""
    known = authors.select("id")
    plan = resolve_aliases(aliases).join(known.withColumnRenamed("id", "cluster_id"), "cluster_id", "left_semi").join(known.withColumnRenamed("id", "canonical_id"), "canonical_id", "left_semi")
    moved = authors.join(plan, F.col("id") == F.col("cluster_id"), "left").withColumn("target", F.coalesce("canonical_id", "id"))
    sums = moved.groupBy("target").agg(F.sum("n_occurrences").alias("n_o"), F.sum("n_reference_citations").alias("n_r"), F.max("n_distinct_papers_citing").alias("n_p"), F.min("openalex_id").alias("oa"), F.min("orcid").alias("oc"))
    cites = citations.join(plan, F.col("author_id") == F.col("cluster_id"), "left").withColumn("author_id", F.coalesce("canonical_id", "author_id")).drop("cluster_id", "canonical_id")
    out = authors.join(sums, F.col("id") == F.col("target")).withColumns({"n_occurrences": F.col("n_o"), "n_reference_citations": F.col("n_r"), "n_distinct_papers_citing": F.col("n_p"), "openalex_id": F.coalesce("openalex_id", "oa"), "orcid": F.coalesce("orcid", "oc")})
    if edges is not None:
        again = reference_citers_of(cites, edges)
        out = out.join(again, out["id"] == again["author_id"], "left").withColumn("n_distinct_papers_citing", F.coalesce("n", F.lit(0)))
    return out.select(*authors.columns), cites


def reference_citers_of(citations: DataFrame, edges: DataFrame) -> DataFrame:
    """(author_id, n): how many papers cite works of each author. Papers go by number, and a work's go to its authors as one
    array, so that no row is made for an author and a paper; a task holds one author's citations at a time, 8 bytes each."""
    papers = numbered(edges.select("citing_id").distinct(), "citing_id", name="__paper")
    citers = edges.join(papers, "citing_id").groupBy("cited_id").agg(F.collect_set("__paper").alias("__papers"))
    works = citations.where("record_kind = 'reference'").select("author_id", F.col("record_id").alias("cited_id")).distinct()
    n = F.size(F.array_distinct(F.flatten(F.collect_list("__papers")))).cast("long")
    return works.join(citers, "cited_id").groupBy("author_id").agg(n.alias("n"))


def reference_citers(edges: DataFrame) -> DataFrame:
    return edges.groupBy("cited_id").agg(F.array_sort(F.collect_set("citing_id")).alias("citing_ids"))


def normalize_authors(references: DataFrame, papers: DataFrame | None = None, edges: DataFrame | None = None, aliases: DataFrame | None = None, mode: str = "strict") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(authors, author_citations, review) of a corpus. ``ord`` is taken from the tables or given by id."""
    order = lambda df: df if "ord" in df.columns else numbered(df, "id")
    occ = occurrences(order(references), "reference")
    if papers is not None:
        more = occurrences(order(papers), "paper").withColumn("ord", F.col("ord") + F.lit(1 << 60))
        occ = occ.unionByName(more)
    table, cites = authors_table(cut(clustered(occ, mode)), edges)
    looked = review(table, cites)
    if aliases is not None:
        table, cites = apply_aliases(table, cites, aliases, edges)
    return table, cites, looked


def surname_set(listed: Column, joined: Column) -> Column:
    """Distinct surname keys of a record."""
    given = F.when(F.size(listed) > 0, listed).otherwise(split_names(joined))
    one = F.transform(given, lambda a: F.when(F.contains(a, F.lit(",")), F.split_part(a, F.lit(","), F.lit(1))).otherwise(F.regexp_extract(a, r"(\S+)\s*$", 1)))
    return F.array_distinct(F.filter(F.transform(one, tx.surname_key), lambda x: x != ""))
