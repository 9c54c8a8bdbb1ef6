"""Command line: python -m quillgraph.cli STAGE OUT. Extraction uses cached records; live extractors are given in code."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from .operators import dedup as dd
from .operators import enrich as en
from .plans.pipeline import Config, Pipeline, estimate_totals, summary_text
from .sources import files, schema


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillgraph")
    p.add_argument("stage", choices=["run", "estimate", "convert", "metadata", "references", "dedup", "enrich", "authors", "status"])
    p.add_argument("out", help="output folder")
    p.add_argument("--raw", help="dedup: a CSV of raw references instead of the folder's table")
    p.add_argument("--pdfs", help="convert: the folder of PDF files")
    p.add_argument("--converter", help="convert: module:function of (path, ocr) that gives markdown")
    p.add_argument("--ocr", choices=["no", "yes", "auto"], default="no")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--crossref", help="enrich: JSON lines of (ref_id, pos, raw)")
    p.add_argument("--openalex", help="enrich: JSON lines of (ref_id, pos, raw)")
    p.add_argument("--threshold", type=float, default=dd.DedupConfig.threshold)
    p.add_argument("--year-window", type=int, default=dd.DedupConfig.year_window)
    p.add_argument("--mode", choices=["strict", "loose"], default="strict")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("quillgraph").getOrCreate()
    try:
        line = Pipeline(spark, a.out, Config(dedup=dd.DedupConfig(threshold=a.threshold, year_window=a.year_window), author_mode=a.mode))
        if a.stage == "estimate":
            print(summary_text(estimate_totals(line.estimate())))
        elif a.stage == "metadata":
            print(line.extract_metadata().count(), "papers")
        elif a.stage == "references":
            print(line.extract_references().count(), "references")
        elif a.stage == "dedup":
            if a.raw:
                raw = files.read_table(spark, a.raw, schema.RAW_PLACED)
                files.write_table(raw, line.at.at("raw"))
            table, edges = line.deduplicate()
            print(table.count(), "references,", edges.count(), "edges")
        elif a.stage == "convert":
            if not a.pdfs or not a.converter:
                raise ValueError("convert needs --pdfs and --converter")
            module, _, name = a.converter.partition(":")
            ocr = {"no": False, "yes": True}.get(a.ocr, "auto")
            print(line.convert(a.pdfs, getattr(importlib.import_module(module), name), ocr, a.recursive), "files")
        elif a.stage == "enrich":
            if not a.crossref or not a.openalex:
                raise ValueError("enrich needs --crossref and --openalex")
            first, second = (spark.read.schema("ref_id string, pos int, raw string").json(x) for x in (a.crossref, a.openalex))
            done = line.enrich(en.crossref(first), en.openalex(second))
            print(en.misses(done).count(), "of", done.count(), "references without a match")
        elif a.stage == "authors":
            print(line.normalize_authors()[0].count(), "authors")
        elif a.stage == "run":
            line.run()
        for name, n in line.status().items():
            print(f"{name}: {'-' if n is None else n}")
    except (files.StageNotReady, NotADirectoryError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
