"""The tables' explicit schemas. Nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import DataFrame

RECORD = "Title string, Authors_List array<string>, Journal string, Year int"
PAPERS = f"{RECORD}, Authors string, source_file string, id string"
RAW_REFERENCES = f"{RECORD}, Authors string, citing_id string"
RAW_PLACED = f"{RAW_REFERENCES}, source_file string, position long, year_ok boolean"  # with their places, and whether the year can be read
REFERENCES = f"id string, Authors string, {RECORD}"
EDGES = "citing_id string, cited_id string"
OPENALEX = "array<struct<display_name:string,openalex_id:string,orcid:string>>"
AUTHORS = "id string, display_name string, surname string, surname_norm string, canonical_given string, initials string, openalex_id string, orcid string, n_occurrences long, n_reference_citations long, n_distinct_papers_citing long"
AUTHOR_CITATIONS = "author_id string, record_kind string, record_id string, position int, citing_paper_id string, raw_author string"
FAILURES = "source_file string, stage string, error_class string, error_message string"


def require_columns(df: DataFrame, needed: list[str], what: str = "table") -> DataFrame:
    """df, or a ValueError that names every absent column."""
    absent = [c for c in needed if c not in df.columns]
    if absent:
        raise ValueError(f"{what} lacks {', '.join(absent)}; it has {', '.join(df.columns)}")
    return df
