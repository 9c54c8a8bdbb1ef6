"""A corpus pipeline of five stages, each the whole of an operator of quillgraph.llm over all that the stage before kept.

quality: documents that the PU classifier rejects go. near_duplicates: of each class of documents that the n-gram Jaccard
join links, the least doc_id stays. repeats: passages of 50 words or more that an earlier document has are cut.
private: personal data are replaced by their kind. packing: the final documents are laid out in batches.

Every stage but the last returns the columns of ``documents``, further and clashing ones among them, untouched but for ``text``
and ``n_chars``. Null and empty texts go in the first stage, as nothing vouches for them; rows with a null doc_id stay in
all stages and are packed as null; rows that repeat a doc_id are one document from the second stage on; very long texts
are worked on whole; ties go to the least doc_id; an empty table gives no rows. The models and hashes cannot be written in
SQL, so ORACLE_SQL is None.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import jaccard_join, packing, pii, quality_pu, shared, suffix_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_pu.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("private", private), ("packing", packed)]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's result written in the shared folder and read again; what a stage kept there for itself
    goes when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared.kept_so_far()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.kept(docs)
            shared.drop_kept(before)
    return docs
