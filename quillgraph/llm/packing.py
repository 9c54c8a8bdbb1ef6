"""Operator 3: packing by optimal length buckets.

Token lengths make one global histogram; dynamic programming over it finds the ``buckets`` upper bounds that minimise
padding, exactly (the cost satisfies the quadrangle inequality, so each layer takes M log M by divide and conquer). In
every bucket batches hold as many documents as fit ``budget`` tokens when padded to the bound.

Places come without a global sort: a document's rank is its rank in a salted part of its bucket plus the sizes of the
parts before. Only ids and lengths are shuffled. The histogram has as many rows as there are distinct lengths;
``step`` rounds lengths up first, where that should be fewer.

Edge cases: null and empty texts have length 0 and are packed too (a bound of 0 counts as 1 token); a document longer than
the budget is a batch of its own; rows that repeat are packed as often as they occur; a null doc_id is packed as null; an
empty table gives no rows; fewer distinct lengths than buckets give as many buckets as lengths; other columns are unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import buckets as parts_of
from .shared import kept, release
from .tokens import VOCABULARY, column_counts

BUCKETS, BUDGET = 16, 16_384


def lengths(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        counts = column_counts(text, path)
        release()
        return pa.array(counts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), count(F.col("text").cast("string")).alias("n_tokens"))


def optimal_bounds(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, rising, of at most ``buckets`` buckets with the least padding. length rises; the last is a bound."""
    m = len(length)
    if not m:
        return []
    c, s = np.concatenate(([0], np.cumsum(count))).astype(float), np.concatenate(([0], np.cumsum(count * length))).astype(float)
    cost = lambda i, j: (c[j] - c[i]) * length[j - 1] - (s[j] - s[i])  # noqa: E731 - of lengths i..j-1 padded to the last
    best = np.array([0.0, *(cost(0, j) for j in range(1, m + 1))])
    cuts = [np.zeros(m + 1, np.int64)]
    for _ in range(1, min(buckets, m)):
        new, cut = best.copy(), np.zeros(m + 1, np.int64)
        stack = [(1, m, 0, m - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            total = best[i] + cost(i, j)
            k = int(np.argmin(total))
            new[j], cut[j] = total[k], i[k]
            stack += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = new
        cuts.append(cut)
    bounds, j = [], m
    for cut in reversed(cuts):
        if j <= 0:
            break
        bounds.append(int(length[j - 1]))
        j = int(cut[j])
    return sorted(set(bounds))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, step: int = 1, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, bucket, bound, batch, slot): batch counts from 0 in each bucket, slot from 0 in each batch."""
    spark = docs.sparkSession
    sized = kept(lengths(docs, path)).withColumn("padded", F.ceil(F.col("n_tokens") / step) * step)
    histogram = sized.groupBy("padded").count().orderBy("padded").toArrow()
    bounds = optimal_bounds(histogram.column("padded").to_numpy(), histogram.column("count").to_numpy(), buckets)
    if not bounds:
        return spark.createDataFrame([], "doc_id long, n_tokens long, bucket int, bound long, batch long, slot long")
    over = [F.when(F.col("padded") > b, 1).otherwise(0) for b in bounds[:-1]]
    placed = sized.withColumn("bucket", sum(over, F.lit(0)).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts_of(spark))))
    before = placed.groupBy("bucket", "part").count()
    before = before.select("bucket", "part", (F.sum("count").over(Window.partitionBy("bucket").orderBy("part")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("n_tokens", "doc_id"))
    ranked = placed.withColumn("rank", rank).join(before, ["bucket", "part"]).withColumn("at", F.col("rank") - 1 + F.col("before"))
    bound = F.element_at(F.array(*[F.lit(int(b)) for b in bounds]), F.col("bucket") + 1).cast("long")
    each = F.greatest(F.lit(1), F.floor(F.lit(int(budget)) / F.greatest(F.col("bound"), F.lit(1)))).cast("long")
    out = ranked.withColumn("bound", bound).withColumn("each", each)
    return out.select("doc_id", "n_tokens", "bucket", "bound", F.floor(F.col("at") / F.col("each")).cast("long").alias("batch"), (F.col("at") % F.col("each")).cast("long").alias("slot"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
