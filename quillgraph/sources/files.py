"""Files in and out: PDFs, markdown, JSON caches, CSV and Parquet tables, sidecars, aliases.

Tables are Parquet inside the engine; CSV and JSON serve exchange. Existence tests are listings or anti-joins against
a cache table, never a loop over rows.
"""

from __future__ import annotations

import ast
import datetime
import json
import os
import shutil
import tempfile
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


CSV = {"header": True, "multiLine": True, "escape": '"'}


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    fs, p = _path(spark, path)
    return bool(fs.exists(p))


def any_file(spark: SparkSession, folder: str, suffix: str) -> bool:
    fs, p = _path(spark, folder)
    return bool(fs.exists(p)) and any(f.getPath().getName().endswith(suffix) for f in fs.listStatus(p))


def count_listed(spark: SparkSession, path: str, inside: str | None = None) -> int:
    """Entries of a report, 0 where there is none; with ``inside`` those of the lists under that name."""
    if not exists(spark, path):
        return 0
    rows = spark.read.option("multiLine", path.endswith(".json")).json(path)
    if inside is None:
        return rows.count()
    return rows.agg(F.coalesce(F.sum(F.size(inside)), F.lit(0))).first()[0] if inside in rows.columns else 0


class StageNotReady(FileNotFoundError):
    """An earlier stage has not written what this one reads."""


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the cluster's shared folder; one of our own where none is set."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def numbered(df: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """df with its rows' ordinals from 0 by the given columns. Rows are range-partitioned and numbered in their partitions;
    only the partitions' sizes meet in one place. Rows that are equal in all those columns are in any order among themselves."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__seq": F.monotonically_increasing_id()})
    placed = cut(placed)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__seq").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n") - F.col("__first")
    return placed.join(F.broadcast(sizes.select("__part", before.alias("__shift"))), "__part").withColumn(name, F.col("__seq") + F.col("__shift")).drop("__part", "__seq", "__shift")


@dataclass(frozen=True)
class Layout:
    """Where each artifact lies under an output folder."""

    root: str

    def at(self, name: str) -> str:
        places = {"markdown": "markdown", "metadata": "metadata", "references": "references", "reports": "reports", "papers": "papers.parquet", "raw": "references_raw.parquet", "canonical": "references.parquet", "graph": "citation_graph.parquet", "enriched": "enriched_references.parquet", "authors": "authors.parquet", "author_citations": "author_citations.parquet", "aliases": "author_aliases.csv", "review": "author_review.json", "enrichment_cache": "enrichment_cache.parquet", "enrichment_misses": "enrichment_misses.csv", "enrichment_summary": "enrichment_summary.json", "conversion_warnings": "conversion_warnings.jsonl", "undercounts": "reference_undercounts.jsonl", "source_duplicates": "reports/source_duplicates.json", "no_references": "reports/papers_without_references.json", "conversion_failures": "conversion_failures.jsonl", "metadata_failures": "metadata_failures.jsonl", "reference_failures": "reference_failures.jsonl", "manifest": "manifest.json", "summary": "run_summary.json"}
        return f"{self.root.rstrip('/')}/{places[name]}"

    def ensure(self) -> Layout:
        for name in ("markdown", "metadata", "references", "reports"):
            Path(self.at(name)).mkdir(parents=True, exist_ok=True)
        return self


def list_pdfs(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, relative): PDF files by name, whatever the case of the suffix; dotted folders are skipped."""
    if not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    root = Path(folder)
    found = root.rglob("*") if recursive else root.iterdir()
    rows = sorted((str(p), str(p.relative_to(root))) for p in found if p.is_file() and p.suffix.lower() == ".pdf" and not any(x.startswith(".") for x in p.relative_to(root).parts[:-1]))
    return spark.createDataFrame(rows, "path string, relative string")


def cache_stem(relative: Column) -> Column:
    """A flat file stem for a relative path: folders joined by two underscores, awkward signs by one."""
    bare = F.regexp_replace(relative, r"\.[^./]*$", "")
    return F.regexp_replace(F.array_join(F.split(bare, "/"), "__"), r"[ \\:]", "_")


def stem_collisions(files: DataFrame) -> DataFrame:
    """(stem, n, paths): stems that more than one file would share."""
    return files.groupBy(cache_stem(F.col("relative")).alias("stem")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("relative")), "|").alias("paths")).where("n > 1")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, content), a row a file."""
    if not any_file(spark, folder, ".md"):
        raise StageNotReady(f"no markdown in {folder}")
    docs = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return docs.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("content"))


def convert_directory(spark: SparkSession, folder: str, out: str, converter, ocr: bool | str = False, recursive: bool = False, overwrite: bool = False) -> DataFrame:
    """(source_file, content, error) of newly converted PDFs. ``converter(path, ocr) -> str`` runs on executors; "auto" sends
    only files without text through OCR, in a second pass. Markdown that exists is skipped by an anti-join."""
    from ..functions.text import is_image_only

    files = list_pdfs(spark, folder, recursive).withColumn("source_file", F.concat(cache_stem(F.col("relative")), F.lit(".md")))
    clash = stem_collisions(files).take(1)
    if clash:
        raise ValueError(f"several files share the stem {clash[0]['stem']}: {clash[0]['paths']}")
    if not overwrite:
        done = spark.createDataFrame([(p.name,) for p in Path(out).glob("*.md")], "source_file string")
        files = files.join(done, "source_file", "left_anti")

    def run(with_ocr: bool):
        def each(batches):
            for pdf in batches:
                rows = []
                for name, path in zip(pdf.source_file, pdf.path, strict=True):
                    try:
                        rows.append((name, path, converter(path, with_ocr), None))
                    except Exception as e:  # noqa: BLE001 - one bad file must not stop the others
                        rows.append((name, path, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["source_file", "path", "content", "error"])

        return each

    kind = "source_file string, path string, content string, error string"
    files = files.select("source_file", "path")
    if ocr != "auto":
        return files.mapInPandas(run(bool(ocr)), kind).drop("path")
    first = cut(files.mapInPandas(run(False), kind))
    again = is_image_only(F.col("content"))
    return first.where(~F.coalesce(again, F.lit(False))).unionByName(first.where(again).select("source_file", "path").mapInPandas(run(True), kind)).drop("path")


def write_markdown(converted: DataFrame, out: str) -> int:
    """One .md for each row with content, written through a temporary name."""

    def each(rows):
        for r in rows:
            target = Path(out, r["source_file"])
            with tempfile.NamedTemporaryFile("w", dir=out, delete=False) as f:
                f.write(r["content"])
            os.replace(f.name, target)

    good = cut(converted.where("content IS NOT NULL"))
    good.foreachPartition(each)
    return good.count()


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A Parquet or CSV table of a known schema. Lists in CSV are JSON or literal text."""
    if not exists(spark, path):
        raise StageNotReady(path)
    if not path.endswith(".csv"):
        return spark.read.schema(kind).parquet(path)
    fields = spark.createDataFrame([], kind).schema.fields
    # Columns go by the header's names; what the file lacks is null. A year is read as text, for it may not be one.
    found = spark.read.options(**CSV).csv(path)
    raw = found.select(*[(F.col(f"`{f.name}`") if f.name in found.columns else F.lit(None).cast("string")).alias(f.name) for f in fields])
    if "Year" in raw.columns and "year_ok" in raw.columns:
        from ..operators.dedup import readable_year

        raw = raw.withColumn("year_ok", readable_year(F.col("Year"))[1])
    if "position" in raw.columns:
        raw = raw.withColumn("position", F.coalesce(F.col("position").try_cast("long"), F.monotonically_increasing_id()))
    raw = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.dataType.typeName() not in ("array", "string") else F.col(f.name) for f in fields])
    for f in fields:
        if f.name == "Authors_List":
            raw = raw.withColumn(f.name, parse_list(F.col(f.name)))
        elif f.dataType.typeName() == "array":
            raw = raw.withColumn(f.name, F.from_json(f.name, f.dataType))
    return raw


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, or CSV with arrays as JSON."""
    if not path.endswith(".csv"):
        df.write.mode("overwrite").parquet(path)
        return
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").options(**CSV).csv(path)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal(cells: pd.Series) -> pd.Series:
    def one(cell):
        try:
            value = ast.literal_eval(cell)
        except (ValueError, SyntaxError, TypeError, MemoryError):
            return None
        return [str(v).strip() for v in value if str(v).strip()] if isinstance(value, (list, tuple)) else None

    return cells.map(one)


def parse_list(cell: Column) -> Column:
    """A text cell as a list: JSON, else a Python literal, else split at semicolons, else itself; blanks give an empty list."""
    tidy = F.trim(F.coalesce(cell, F.lit("")))
    brackets = tidy.startswith("[")
    clean = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")
    strict = F.from_json(tidy, "array<string>", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    listed = F.coalesce(clean(strict), _literal(F.when(brackets & strict.isNull(), tidy)))
    return F.when(tidy == "", F.array().cast("array<string>")).when(brackets & listed.isNotNull(), listed).otherwise(clean(F.split(tidy, ";")))


def read_json_cache(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """A row a cached record, with the file's stem."""
    if not any_file(spark, folder, ".json"):
        return spark.createDataFrame([], f"{kind}, stem string")
    raw = spark.read.schema(kind).option("multiLine", True).json(folder)
    return raw.withColumn("stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))


def uncached(items: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return items.join(cache.select(key).distinct(), key, "left_anti")


def write_json_atomic(path: str, value) -> None:
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False) as f:
        json.dump(value, f, ensure_ascii=False, indent=2, default=str)
    os.replace(f.name, path)


def write_failures(failed: DataFrame, path: str) -> int:
    """JSON lines of failures. Without any the file is removed: absent means clean."""
    failed = cut(failed)
    n = failed.count()
    shutil.rmtree(path, ignore_errors=True)
    if n:
        failed.write.mode("overwrite").json(path)
    return n


def write_sidecar(rows: DataFrame, path: str) -> int:
    """As write_failures, as one JSON list; sidecars are review lists for people and meant to be short."""
    found = [json.loads(r) for r in rows.toJSON().collect()]
    if found:
        write_json_atomic(path, found)
    elif os.path.exists(path):
        os.remove(path)
    return len(found)


def count_duplicates(groups: DataFrame) -> int:
    """Files listed as duplicates over all groups."""
    return groups.agg(F.coalesce(F.sum(F.size("duplicate_source_files")), F.lit(0))).first()[0]


def write_manifest(path: str, stage: str, artifacts: dict[str, str], config: dict, version: str = "1") -> dict:
    value = {"schema_version": 1, "package_version": version, "generated_at": datetime.datetime.now(datetime.timezone.utc).isoformat(), "stage": stage, "artifacts": artifacts, "config": config}
    write_json_atomic(path, value)
    return value


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, canonical_id) of a two-column text: # comments, maybe a header; the last line for an id holds. No file, no rows."""
    kind = "cluster_id string, canonical_id string"
    if not os.path.exists(path):
        return spark.createDataFrame([], kind)
    with open(path, encoding="utf-8") as f:
        lines = [line.split("#")[0].split(",") for line in f]
    pairs = {x[0].strip(): x[1].strip() for x in lines if len(x) >= 2 and x[0].strip() and x[1].strip() and x[0].strip().lower() != "cluster_id"}
    return spark.createDataFrame(sorted(pairs.items()), kind)
