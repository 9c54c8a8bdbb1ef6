"""The stages from documents to author tables. Each reads and writes tables under one output folder, so stages resume
on their own; a paper that fails is reported and does not stop the others."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import authors as au
from ..operators import dedup as dd
from ..operators import enrich as en
from ..operators import evaluate as ev
from ..sources import files, schema

PRICES = {"small": (0.10, 0.40), "medium": (0.30, 2.50), "large": (1.25, 10.00)}  # dollars a million tokens, in and out
_RECORD = f"source_file string, {schema.RECORD}, error_class string, error_message string, position long, truncated boolean"
CAP, HARD_CAP = 20_000, 80_000  # tokens of an answer: asked for, and at most where one was cut off


class Truncated(Exception):
    """Raised by an extractor whose answer was cut off; ``records`` are those that could be read."""

    def __init__(self, records: list[dict] | None = None) -> None:
        super().__init__("the answer was cut off")
        self.records = records or []


Extractor = Callable[[str], list[dict]]


class Result(NamedTuple):
    papers: DataFrame
    references: DataFrame
    graph: DataFrame
    authors: DataFrame | None = None
    author_citations: DataFrame | None = None


@dataclass(frozen=True)
class Config:
    dedup: dd.DedupConfig = field(default_factory=dd.DedupConfig)
    enrich: en.EnrichConfig = field(default_factory=en.EnrichConfig)
    author_mode: str = "strict"
    metadata_chars: int = tx.METADATA_CHARS
    concurrency: int = 4  # extractor calls at once in each task
    model: str = "small"  # what estimates are priced by

    def __post_init__(self) -> None:
        if self.concurrency < 1:
            raise ValueError("concurrency is at least 1")


def extract(content: DataFrame, extractor: Extractor, retries: int = 0, concurrency: int = 1, cap: int = CAP) -> DataFrame:
    """Records that ``extractor(text)`` finds in each document (source_file, content), with their position, or its error in
    columns. Each task makes ``concurrency`` calls at once and keeps the documents' order. An extractor with a parameter
    ``max_tokens`` is given ``cap``; if it raises Truncated it is asked once more, with twice as much (``HARD_CAP`` at
    most), and if that is cut off too its records are taken and marked."""
    capped = "max_tokens" in inspect.signature(extractor).parameters
    call = (lambda text, n: extractor(text, max_tokens=n)) if capped else (lambda text, n: extractor(text))

    def answer(text: str) -> tuple[list, bool]:
        try:
            return call(text, cap), False
        except Truncated as first:
            if not capped or min(2 * cap, HARD_CAP) <= cap:
                return first.records, True
        try:
            return call(text, min(2 * cap, HARD_CAP)), False
        except Truncated as second:
            return second.records, True

    def one(name: str, text: str) -> list[tuple]:
        for attempt in range(retries + 1):
            try:
                found, cut_off = answer(text)
                return [(name, r.get("Title") or "", list(r.get("Authors_List") or []), r.get("Journal") or "", _year(r.get("Year")), None, None, k, cut_off) for k, r in enumerate(found)]
            except Exception as e:  # noqa: BLE001 - becomes a row of the failure report
                if attempt == retries:
                    return [(name, None, None, None, None, type(e).__name__, str(e), None, None)]
        return []

    def each(batches):
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                rows = [r for found in pool.map(one, pdf.source_file, pdf.content) for r in found]
                yield pd.DataFrame(rows, columns=["source_file", "Title", "Authors_List", "Journal", "Year", "error_class", "error_message", "position", "truncated"]).astype({"Year": "Int32", "position": "Int64", "truncated": "boolean"})

    return content.select("source_file", "content").mapInPandas(each, _RECORD)


def _year(value) -> int:
    """A missing year is 0; one that can't be read is the paper's error."""
    return 0 if value is None or value == "" else int(value)


def failures(extracted: DataFrame, stage: str) -> DataFrame:
    return extracted.where("error_class IS NOT NULL").select("source_file", F.lit(stage).alias("stage"), "error_class", "error_message")


def papers_of(extracted: DataFrame) -> DataFrame:
    good = extracted.where("error_class IS NULL").drop("error_class", "error_message")
    named = good.withColumns({"Authors": F.array_join("Authors_List", ", "), "id": tx.record_id("p", F.lit(""), F.col("Year"), F.col("Title"), F.col("Authors_List"))})
    return dd.first_by_id(named, "source_file")


def raw_references_of(extracted: DataFrame, papers: DataFrame) -> DataFrame:
    good = extracted.where("error_class IS NULL").drop("error_class", "error_message")
    known, _ = dd.source_to_id(good, papers)
    return known.withColumns({"Authors": F.array_join("Authors_List", ", "), "citing_id": F.col("id"), "year_ok": F.lit(True)}).select("Title", "Authors_List", "Journal", "Year", "Authors", "citing_id", "source_file", "position", "year_ok")


def undercounts(content: DataFrame, extracted: DataFrame) -> DataFrame:
    """(source_file, estimate, extracted) of papers with a bibliography of which far fewer references were extracted than
    the text before it cites."""
    n = extracted.where("error_class IS NULL").groupBy("source_file").agg(F.count("*").alias("extracted"))
    cited = content.select("source_file", tx.reference_section(F.col("content")).isNotNull().alias("found"), tx.inline_citations(tx.body(F.col("content"))).alias("estimate"))
    both = cited.join(n, "source_file", "left").withColumn("extracted", F.coalesce("extracted", F.lit(0)))
    return both.where(tx.undercounted(F.col("found"), F.col("estimate"), F.col("extracted"))).select("source_file", "estimate", "extracted")


def conversion_warnings(content: DataFrame, ocr: bool = False) -> DataFrame:
    """(source_file, reason) of markdown that is images only; the reason tells whether text recognition was tried."""
    reason = "only images, even after text recognition; look at it by hand" if ocr else "only images; maybe a scan, to be converted with text recognition"
    return content.where(tx.is_image_only(F.col("content"))).select("source_file", F.lit(reason).alias("reason"))


def estimate(content: DataFrame, cached_metadata: DataFrame | None = None, cached_references: DataFrame | None = None, metadata_chars: int = tx.METADATA_CHARS) -> DataFrame:
    """A row a file: the tokens that extraction would read and the references it may find; 0 where a cache has them."""
    section = tx.reference_section(F.col("content"))
    whole = F.length("content")
    part = F.length(F.coalesce(section, F.col("content")))
    head = F.least(whole, F.lit(metadata_chars)) if metadata_chars else whole
    out = content.select(
        "source_file",
        tx.tokens(head + tx.METADATA_PROMPT).alias("metadata_tokens"),
        tx.tokens(part + tx.REFERENCES_PROMPT).alias("reference_tokens"),
        F.greatest(F.lit(1), F.floor(part / tx.CHARS_PER_REFERENCE)).cast("long").alias("references"),
        section.isNotNull().alias("has_section"),
    )
    for cache, columns in ((cached_metadata, ["metadata_tokens"]), (cached_references, ["reference_tokens", "references"])):
        if cache is not None:
            done = cache.select("source_file").distinct().withColumn("done", F.lit(True))
            out = out.join(done, "source_file", "left").withColumns({c: F.when(F.col("done"), F.lit(0).cast("long")).otherwise(F.col(c)) for c in columns}).drop("done")
    return out


def estimate_totals(per_file: DataFrame) -> DataFrame:
    sums = per_file.agg(
        F.count_if(F.col("metadata_tokens") > 0).alias("n_metadata"),
        F.count_if(F.col("reference_tokens") > 0).alias("n_references"),
        F.coalesce(F.sum(F.col("metadata_tokens") + F.col("reference_tokens")), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.sum("references"), F.lit(0)).cast("long").alias("estimated_references"),
    )
    return sums.withColumn("output_tokens", F.lit(tx.METADATA_OUTPUT) * F.col("n_metadata") + F.lit(tx.REFERENCE_OUTPUT) * F.col("estimated_references"))


def cost(totals: DataFrame, models: list[str]) -> DataFrame:
    """(model, usd) for each model; null for one without a price."""
    spark = totals.sparkSession
    asked = spark.createDataFrame([(m,) for m in models], "model string")
    prices = spark.createDataFrame([(m, a, b) for m, (a, b) in PRICES.items()], "model string, price_in double, price_out double")
    priced = asked.join(prices, "model", "left")  # both are short literals
    return priced.crossJoin(totals).select("model", ((F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1e6).alias("usd"))


def summary_text(totals: DataFrame, model: str = "small") -> str:
    t = totals.first()
    usd = cost(totals, [model]).first()["usd"]
    return f"{t['n_metadata']} metadata and {t['n_references']} reference calls, {t['input_tokens']} tokens in, about {t['output_tokens']} out, " + ("price unknown" if usd is None else f"${usd:.4f}")


class Pipeline:
    """Stages over an output folder. Extractors are functions of a text; without any only cached records are used."""

    def __init__(self, spark: SparkSession, out: str, config: Config = Config(), metadata: Extractor | None = None, references: Extractor | None = None) -> None:
        self.spark, self.at, self.config, self._metadata, self._references = spark, files.Layout(out).ensure(), config, metadata, references

    def _table(self, name: str, kind: str) -> DataFrame:
        return files.read_table(self.spark, self.at.at(name), kind)

    def convert(self, pdfs: str, converter, ocr: bool | str = False, recursive: bool = False, overwrite: bool = False) -> int:
        done = files.cut(files.convert_directory(self.spark, pdfs, self.at.at("markdown"), converter, ocr, recursive, overwrite))
        n = files.write_markdown(done, self.at.at("markdown"))
        bad = done.where("error IS NOT NULL").select("source_file", F.lit("convert").alias("stage"), F.lit("ConversionError").alias("error_class"), F.col("error").alias("error_message"))
        files.write_failures(bad, self.at.at("conversion_failures"))
        if files.any_file(self.spark, self.at.at("markdown"), ".md"):
            files.write_failures(conversion_warnings(files.read_markdown(self.spark, self.at.at("markdown")), bool(ocr)), self.at.at("conversion_warnings"))
        return n

    def _cache(self, name: str) -> DataFrame:
        store = f"{self.at.at(name)}/cache.parquet"
        return self.spark.read.schema(_RECORD).parquet(store) if files.exists(self.spark, store) else self.spark.createDataFrame([], _RECORD)

    def _extracted(self, name: str, extractor: Extractor | None, content: DataFrame, retries: int) -> DataFrame:
        """Cached records and newly extracted ones; the new go to the cache, failures don't."""
        store = f"{self.at.at(name)}/cache.parquet"
        cached = self._cache(name)
        cached = files.cut(cached)
        if extractor is None:
            return cached
        new = files.cut(extract(files.uncached(content, cached, "source_file"), extractor, retries, self.config.concurrency))
        new.where("error_class IS NULL").write.mode("append").parquet(store)
        return cached.unionByName(new)

    def extract_metadata(self) -> DataFrame:
        content = files.read_markdown(self.spark, self.at.at("markdown")).withColumn("content", tx.metadata_input(F.col("content"), self.config.metadata_chars))
        found = files.cut(self._extracted("metadata", self._metadata, content, 2))
        files.write_failures(failures(found, "metadata"), self.at.at("metadata_failures"))
        files.write_table(papers_of(found).select("Title", "Authors_List", "Journal", "Year", "Authors", "source_file", "id"), self.at.at("papers"))
        papers = self._table("papers", schema.PAPERS)
        files.write_sidecar(dd.source_duplicates(files.numbered(papers, "source_file"), self.config.dedup, details=True), self.at.at("source_duplicates"))
        return papers

    def extract_references(self) -> DataFrame:
        papers = self._table("papers", schema.PAPERS)
        content = files.read_markdown(self.spark, self.at.at("markdown")).join(papers.select("source_file"), "source_file", "left_semi")
        section = tx.reference_section(F.col("content"))
        found = files.cut(self._extracted("references", self._references, content.select("source_file", F.coalesce(section, F.col("content")).alias("content")), 1))
        files.write_failures(undercounts(content, found), self.at.at("undercounts"))
        bad = failures(found, "references")
        files.write_failures(bad, self.at.at("reference_failures"))
        files.write_table(raw_references_of(found, papers), self.at.at("raw"))
        raw = self._table("raw", schema.RAW_PLACED)
        files.write_sidecar(dd.without_references(papers, raw, bad).select("id", "source_file"), self.at.at("no_references"))
        return raw

    def deduplicate(self) -> tuple[DataFrame, DataFrame]:
        raw = dd.complete(schema.require_columns(self._table("raw", schema.RAW_PLACED), ["Title", "Year", "citing_id"], "references_raw"))
        # In the order of files, and of records in a file; what has no place comes in the order of its content.
        records = files.cut(files.numbered(raw, "source_file", "position", "citing_id", "Title", "Authors", "Journal", "Year"))
        table, mapping = dd.canonical(records, dd.cluster(records, self.config.dedup))
        mapping = files.cut(mapping)
        files.write_table(table.select("id", "Authors", "Title", "Authors_List", "Journal", "Year"), self.at.at("canonical"))
        files.write_table(dd.citation_edges(records, mapping), self.at.at("graph"))
        return self.spark.read.parquet(self.at.at("canonical")), self._table("graph", schema.EDGES)

    def enrich(self, crossref: DataFrame, openalex: DataFrame) -> DataFrame:
        """References with what the catalogues know. Each reference is matched once: hits and misses are cached by id, but for
        those that met an error."""
        references, store = self.spark.read.parquet(self.at.at("canonical")), self.at.at("enrichment_cache")
        known = files.cut(en.backfilled(self.spark.read.parquet(store))) if files.exists(self.spark, store) else None
        pending = references if known is None else files.uncached(references, known, "id")
        new = files.cut(en.enriched(pending, crossref, openalex, self.config.enrich))
        new.where("coalesce(enrichment_miss_reason, '') <> 'http_error'").write.mode("append").parquet(store)
        out = new if known is None else new.unionByName(known.join(references.select("id").distinct(), "id", "left_semi"), allowMissingColumns=True)
        files.write_table(out, self.at.at("enriched"))
        done = self.spark.read.parquet(self.at.at("enriched"))
        files.write_table(en.misses(done).select(*[c for c in en.MISS_COLUMNS if c in done.columns]), self.at.at("enrichment_misses"))
        files.write_json_atomic(self.at.at("enrichment_summary"), {**en.summary(done), "config": asdict(self.config.enrich)})
        return done

    def maybe_enrich(self, catalogues: tuple[DataFrame, DataFrame] | None) -> DataFrame:
        """The enriched references, or without catalogues the canonical ones as they are."""
        return self.enrich(*catalogues) if catalogues else self.spark.read.parquet(self.at.at("canonical"))

    def normalize_authors(self) -> tuple[DataFrame, DataFrame]:
        where = "enriched" if files.exists(self.spark, self.at.at("enriched")) else "canonical"
        aliases = files.read_aliases(self.spark, self.at.at("aliases"))
        table, cites, doubtful = au.normalize_authors(self.spark.read.parquet(self.at.at(where)), self._table("papers", schema.PAPERS), self._table("graph", schema.EDGES), aliases, self.config.author_mode)
        files.write_table(table, self.at.at("authors"))
        files.write_table(cites, self.at.at("author_citations"))
        files.write_sidecar(doubtful, self.at.at("review"))
        return self.spark.read.parquet(self.at.at("authors")), self.spark.read.parquet(self.at.at("author_citations"))

    def estimate(self) -> DataFrame:
        """What extraction would still cost: what is cached costs nothing."""
        return estimate(files.read_markdown(self.spark, self.at.at("markdown")), self._cache("metadata"), self._cache("references"), self.config.metadata_chars)

    def status(self) -> dict[str, int | None]:
        """Rows of each table, None where it is absent."""
        found = {n: self.at.at(n) for n in ("papers", "raw", "canonical", "graph", "enriched", "authors", "author_citations")}
        return {n: self.spark.read.parquet(p).count() if files.exists(self.spark, p) else None for n, p in found.items()}

    def run(self, authors: bool = True, pdfs: str | None = None, converter=None, ocr: bool | str = False, catalogues: tuple[DataFrame, DataFrame] | None = None) -> Result:
        """All stages in order: conversion where a folder of PDFs and a converter are given, enrichment where candidate tables
        of both catalogues are."""
        if pdfs is not None and converter is not None:
            self.convert(pdfs, converter, ocr)
        papers = self.extract_metadata()
        self.extract_references()
        references, graph = self.deduplicate()
        references = self.maybe_enrich(catalogues)
        people = self.normalize_authors() if authors else (None, None)
        counts = self.status()
        listed = lambda name: files.count_listed(self.spark, self.at.at(name))
        summary = {
            "n_papers": counts["papers"], "n_references_raw": counts["raw"], "n_references_dedup": counts["canonical"], "n_edges": counts["graph"], "n_authors": counts["authors"] or 0, "n_author_citations": counts["author_citations"] or 0,
            "n_author_review_flags": listed("review"), "n_metadata_failures": listed("metadata_failures"), "n_references_failures": listed("reference_failures"),
            "n_source_duplicates": files.count_listed(self.spark, self.at.at("source_duplicates"), "duplicate_source_files"), "n_papers_no_references": listed("no_references"), "n_conversion_warnings": listed("conversion_warnings"),
            "model": self.config.model, "enrich": catalogues is not None, "dedup_config": asdict(self.config.dedup), "author_config": {"mode": self.config.author_mode},
        }
        files.write_json_atomic(self.at.at("summary"), {**counts, **summary, "config": asdict(self.config)})
        files.write_manifest(self.at.at("manifest"), "run", {n: self.at.at(n) for n, c in counts.items() if c is not None}, asdict(self.config))
        return Result(papers, references, graph, *people)

    def evaluate(self, gold: str) -> dict:
        """Metadata, references and clusters against a folder of gold files (see operators.evaluate)."""
        return ev.evaluate(self.spark, gold, self._table("papers", schema.PAPERS), self._cache("references").where("error_class IS NULL"), self.spark.read.parquet(self.at.at("raw")) if files.exists(self.spark, self.at.at("raw")) else None)
