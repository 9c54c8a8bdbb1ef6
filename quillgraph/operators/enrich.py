"""Matching references with candidates of two catalogues, offline: candidate tables instead of requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import ratio_of

PRIORITY = {"http_error": 4, "year_mismatch": 3, "below_title_threshold": 2, "no_crossref_candidates": 1, "no_openalex_candidates": 1, "empty_title": 0}
CROSSREF = "title array<string>, author array<struct<given:string,family:string,ORCID:string>>, `container-title` array<string>, issued struct<`date-parts`:array<array<int>>>, DOI string"
OPENALEX = "title string, display_name string, authorships array<struct<author:struct<display_name:string,id:string,orcid:string>>>, primary_location struct<source:struct<display_name:string>>, publication_year int, doi string"
_LINKS = r"^https?://(?:dx\.)?(?:doi|orcid|openalex)\.org/"


@dataclass(frozen=True)
class EnrichConfig:
    threshold: float = 90.0
    rows: int = 3  # candidates asked for
    year_penalty: float = 8.0
    retries: int = 3
    wait: float = 0.5  # seconds before the first retry


def bare_id(link: Column) -> Column:
    return F.regexp_replace(link, _LINKS, "")


def crossref(items: DataFrame, raw: str = "raw") -> DataFrame:
    """(ref_id, pos, title, year, journal, doi, authors, OpenAlex_Authors) of raw CrossRef items in JSON."""
    x = items.withColumn("x", F.from_json(raw, CROSSREF))
    name = lambda a: F.concat_ws(" ", a["given"], a["family"])
    return x.select("ref_id", "pos", F.expr("x.title[0]").alias("title"), F.expr("x.issued.`date-parts`[0][0]").alias("year"), F.expr("x.`container-title`[0]").alias("journal"), bare_id(F.col("x.DOI")).alias("doi"), F.filter(F.transform("x.author", name), lambda a: a != "").alias("authors"), F.transform("x.author", lambda a: F.struct(name(a).alias("display_name"), F.lit(None).cast("string").alias("openalex_id"), bare_id(a["ORCID"]).alias("orcid"))).alias("OpenAlex_Authors"))


def openalex(items: DataFrame, raw: str = "raw") -> DataFrame:
    x = items.withColumn("x", F.from_json(raw, OPENALEX))
    who = F.transform("x.authorships", lambda a: F.struct(a["author"]["display_name"].alias("display_name"), bare_id(a["author"]["id"]).alias("openalex_id"), bare_id(a["author"]["orcid"]).alias("orcid")))
    return x.select("ref_id", "pos", F.coalesce(F.nullif("x.title", F.lit("")), "x.display_name").alias("title"), F.col("x.publication_year").alias("year"), F.col("x.primary_location.source.display_name").alias("journal"), bare_id(F.col("x.doi")).alias("doi"), F.transform("x.authorships", lambda a: a["author"]["display_name"]).alias("authors"), who.alias("OpenAlex_Authors"))


def best_candidate(references: DataFrame, candidates: DataFrame, source: str, config: EnrichConfig = EnrichConfig()) -> DataFrame:
    """A row a reference: its best candidate and why it was not taken, if it was not.

    references: id, Title, Year. candidates: ref_id, pos, title, year and what else is to be carried along. The highest
    adjusted score wins, the first of equal ones; scores of 0 or less count as no candidate.
    """
    carried = [c for c in candidates.columns if c not in ("ref_id", "pos", "title", "year")]
    refs = references.select("id", F.coalesce("Title", F.lit("")).alias("Title"), "Year")
    offered = candidates.where("title <> ''").select(F.col("ref_id").alias("id"), "pos", F.col("title").alias("candidate_title"), F.col("year").alias("candidate_year"), *carried)
    delta = F.abs(F.when(F.col("Year") > 0, F.col("Year")) - F.col("candidate_year"))
    scored = refs.where("trim(Title) <> ''").join(offered, "id").withColumns({"title_score": ratio_of(F.lower("Title"), F.lower("candidate_title")), "year_delta": delta})
    scored = scored.withColumn("adjusted_score", F.col("title_score") - F.when(F.col("year_delta") > 0, F.lit(config.year_penalty)).otherwise(0.0)).where("adjusted_score > 0")
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("adjusted_score"), "pos"))
    best = scored.withColumn("n", first).where("n = 1").drop("n", "Title", "Year", "pos")
    out = refs.join(best, "id", "left")
    mismatch = (F.col("title_score") >= config.threshold) & (F.col("year_delta") > 0)
    reason = F.when(F.trim("Title") == "", "empty_title").when(F.col("title_score").isNull(), f"no_{source}_candidates").when(F.col("adjusted_score") >= config.threshold, F.lit(None)).when(mismatch, "year_mismatch").otherwise("below_title_threshold")
    return out.withColumns({"miss_reason": reason, "year_match": F.col("year_delta") == 0, "source": F.lit(source)})


def _urgency(reason: Column) -> Column:
    level = F.lit(-1)
    for name, p in PRIORITY.items():
        level = F.when(reason == name, p).otherwise(level)
    return level * 2 + F.when(reason == "no_openalex_candidates", 1).otherwise(0)


def enriched(references: DataFrame, first: DataFrame, second: DataFrame, config: EnrichConfig = EnrichConfig()) -> DataFrame:
    """references with status, source and diagnostics. The second catalogue is asked only for what the first missed; of
    two misses the graver one is told. Fields of a match replace the reference's where they are not empty."""
    a = best_candidate(references, first, "crossref", config)
    missed = a.where("miss_reason IS NOT NULL").select("id")
    b = best_candidate(references.join(missed, "id", "left_semi"), second, "openalex", config)
    fields = ["candidate_title", "candidate_year", "title_score", "adjusted_score", "year_match", "year_delta", "miss_reason", "source", "journal", "doi", "authors", "OpenAlex_Authors"]
    pack = lambda df, name: df.select("id", F.struct(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in fields]).alias(name))
    both = pack(a, "a").join(pack(b, "b"), "id", "left")
    use_b = F.col("a.miss_reason").isNotNull() & F.col("b.source").isNotNull() & (F.col("b.miss_reason").isNull() | (_urgency(F.col("b.miss_reason")) > _urgency(F.col("a.miss_reason"))))
    picked = both.select("id", F.when(use_b, F.col("b")).otherwise(F.col("a")).alias("m")).select("id", "m.*").withColumnsRenamed({"journal": "found_journal", "authors": "found_authors"})
    hit = F.col("miss_reason").isNull()
    out = references.join(picked, "id", "left")
    new = {"enrichment_status": F.when(hit, "matched").otherwise("miss"), "enrichment_source": F.when(hit, F.col("source")), "doi": F.when(hit, F.nullif("doi", F.lit("")))}
    people = F.when(F.size("found_authors") > 0, F.col("found_authors"))
    better = {"Title": F.nullif("candidate_title", F.lit("")), "Journal": F.nullif("found_journal", F.lit("")), "Year": F.when(F.col("candidate_year") != 0, F.col("candidate_year")), "Authors_List": people, "Authors": F.array_join(people, ", ")}
    for name, value in better.items():
        if name in references.columns:
            new[name] = F.when(hit, F.coalesce(value.cast(references.schema[name].dataType), references[name])).otherwise(references[name])
    keep = [c for c in references.columns if c not in new]
    return out.select(*[references[c] for c in keep], *[e.alias(n) for n, e in new.items()], F.col("miss_reason").alias("enrichment_miss_reason"), *[F.col(c).alias(f"enrichment_{c}") for c in ("title_score", "adjusted_score", "candidate_title", "year_match", "year_delta")], F.when(hit, F.col("OpenAlex_Authors")).alias("OpenAlex_Authors"))


MISS_COLUMNS = ["id", "Title", "Authors", "Year", "Journal", "enrichment_miss_reason", "enrichment_title_score", "enrichment_adjusted_score", "enrichment_candidate_title", "enrichment_year_match", "enrichment_year_delta"]


def misses(table: DataFrame) -> DataFrame:
    return table.where("enrichment_status = 'miss'")


def backfilled(cache: DataFrame) -> DataFrame:
    """A cache written before there were diagnostics, with them: what has a doi or a source was matched."""
    has = lambda c: F.col(c) if c in cache.columns else F.lit(None).cast("string")
    status = F.coalesce(has("enrichment_status"), F.when(has("doi").isNotNull() | has("enrichment_source").isNotNull(), "matched").otherwise("miss"))
    out = cache.withColumn("enrichment_status", status)
    out = out.withColumn("enrichment_miss_reason", F.when(F.col("enrichment_status") == "miss", F.coalesce(has("enrichment_miss_reason"), F.lit("cached_miss"))))
    kinds = {"title_score": "double", "adjusted_score": "double", "candidate_title": "string", "year_match": "boolean", "year_delta": "int"}
    absent = {f"enrichment_{c}": F.lit(None).cast(k) for c, k in kinds.items() if f"enrichment_{c}" not in cache.columns}
    return out.withColumns(absent) if absent else out


def requested(references: DataFrame, request, config: EnrichConfig = EnrichConfig()) -> DataFrame:
    """(ref_id, pos, raw, error): candidates that ``request(title, year, rows)`` gives as a list of JSON texts, asked on
    executors once a title that isn't blank. A call that fails is tried again after twice the wait, ``retries`` times; then
    its reference has one row with the error, which no cache should hold."""
    import json
    import time

    import pandas as pd

    def each(batches):
        for pdf in batches:
            rows = []
            for ref, title, year in zip(pdf["id"], pdf["Title"], pdf["Year"], strict=True):
                for attempt in range(config.retries + 1):
                    try:
                        found = request(title, None if pd.isna(year) or year <= 0 else int(year), config.rows)
                        rows += [(ref, k, x if isinstance(x, str) else json.dumps(x), None) for k, x in enumerate(found)]
                        break
                    except Exception as e:  # noqa: BLE001 - becomes a row
                        if attempt == config.retries:
                            rows.append((ref, None, None, f"{type(e).__name__}: {e}"))
                        else:
                            time.sleep(config.wait * 2**attempt)
            yield pd.DataFrame(rows, columns=["ref_id", "pos", "raw", "error"]).astype({"pos": "Int32"})

    asked = references.where("trim(Title) <> ''").select("id", "Title", "Year")
    return asked.mapInPandas(each, "ref_id string, pos int, raw string, error string")


def summary(table: DataFrame) -> dict:
    """Numbers of references, matches and misses, the share of matches, and matches by source."""
    counts = {r["source"]: r["n"] for r in by_source(table).collect()}
    total, missed = sum(counts.values()), counts.get("miss", 0)
    return {"n_references": total, "n_matched": total - missed, "n_missed": missed, "match_rate": (total - missed) / total if total else 0.0, "sources": counts}


def by_source(table: DataFrame) -> DataFrame:
    """(source, n, rate) with 'miss' for the unmatched."""
    n = table.groupBy(F.coalesce("enrichment_source", F.lit("miss")).alias("source")).agg(F.count("*").alias("n"))
    return n.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy()))
