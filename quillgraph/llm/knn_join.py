"""Operator 10: exact k nearest neighbours of a set of queries among all vectors (Voronoi kNN join; Lu et al., 2012).

1. Pivots, about the root of the number of vectors (or one for ``cell_rows``), are vectors with the least hashes of
   their ids. Each vector goes to its nearest pivot's cell.
2. A cell's summary is its radius over queries and the k + 1 least distances of its data to the pivot. From the summaries
   alone, each cell of queries gets a bound on its k-th neighbours' distance: the (k + 1)-th least of
   radius(i) + |pivot i - pivot j| + |pivot j - s|. The bounds are found in parallel, a row of pivots at a time.
3. Cells of queries near one another form a group, the root of their number of them; a group of more than ``GROUP`` queries
   is several. A vector of cell j is copied to a group only if, for a cell i of it, |pivot i - pivot j| differs from
   |pivot j - s| by no more than radius(i) and the bound.
4. A group's data are spread over tasks, each of which has the group's queries, streams its share past them in blocks,
   and keeps the k best; the best of all shares are the answer.

Queries are the rows whose vec_id is divisible by ``every`` (1: all). Distances are Euclidean, in doubles; ties go to the
smaller id; a vector is not its own neighbour. What is broadcast are pivots and summaries, the root of n rows. Where
bounds can't separate cells (high dimensions), all data go to all groups, as exactness asks.

Edge cases: rows with a null id, a null, empty or not finite vector, or of another length than most (the shorter, if
tied) are left out; rows that repeat an id count once, with the least vector; fewer than k others give fewer
neighbours; equal vectors are neighbours at distance 0; an empty table or one without queries gives no rows; other columns
are unread.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .shared import PACKED, buckets, kept, packed_batch, place, sample_ids, tidy
from .words import mix

K, EVERY = 10, 100
GROUP = 1 << 16  # queries that a task holds
_OUT = "vec_id long, neighbor_id long, rank int, distance double"


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): usable vectors of the most common length, one an id."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = good.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad)
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size("v") == (common["d"] if common else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to the one vector b."""
    return np.sqrt(((a - b) ** 2).sum(1))


def nearest(vectors: DataFrame, k: int = K, cell_rows: int | None = None, every: int = 1) -> DataFrame:
    """(vec_id, neighbor_id, rank, distance), rank from 1."""
    spark = vectors.sparkSession
    data = kept(clean(vectors))
    total = data.count()
    if not total:
        return spark.createDataFrame([], _OUT)
    wanted = -(-total // cell_rows) if cell_rows else math.isqrt(total - 1) + 1
    chosen = sample_ids(data.select("vec_id"), max(1, wanted), "pivots")
    pivots = _matrix(data.join(chosen, "vec_id").orderBy("vec_id").select("v").toArrow().column("v").combine_chunks())
    half = (pivots**2).sum(1)
    wire = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else np.float64

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            step = max(1, 4_000_000 // len(pivots))
            cell = np.concatenate([np.argmin(half - 2 * x[lo : lo + step] @ pivots.T, axis=1) for lo in range(0, len(x), step)])
            d = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array(d), batch.column("v")], ["vec_id", "cell", "d", "v"])

    cells = kept(data.mapInArrow(tidy(assign), "vec_id long, cell int, d double, v array<double>"))

    def least(batches):
        held: dict[int, np.ndarray] = {}
        far: dict[int, float] = {}
        asked: dict[int, int] = {}
        for batch in batches:
            cell, d, query = batch.column("cell").to_numpy(), batch.column("d").to_numpy(), batch.column("vec_id").to_numpy() % every == 0
            order = np.argsort(cell, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
                c, mine = int(cell[part[0]]), part[query[part]]
                if len(mine):
                    far[c] = max(far.get(c, 0.0), float(d[mine].max()))
                    asked[c] = asked.get(c, 0) + len(mine)
                held[c] = np.sort(np.concatenate((held.get(c, np.zeros(0)), d[part])))[: k + 1]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([far.get(c) for c in held], pa.float64()), pa.array([asked.get(c, 0) for c in held], pa.int64()), pa.array([held[c].tolist() for c in held], pa.list_(pa.float64()))], ["cell", "far", "asked", "least"])

    summary = cells.select("vec_id", "cell", "d").mapInArrow(tidy(least), "cell int, far double, asked long, least array<double>")
    summary = summary.groupBy("cell").agg(F.max("far").alias("far"), F.sum("asked").alias("asked"), F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, k + 1).alias("least")).toArrow().to_pylist()
    radius, asked = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    close = np.full((len(pivots), k + 1), np.inf)
    for row in summary:
        radius[row["cell"]], asked[row["cell"]] = row["far"] or 0.0, row["asked"]
        close[row["cell"], : len(row["least"])] = row["least"]
    own = np.flatnonzero(asked)  # cells with queries
    if not len(own):
        return spark.createDataFrame([], _OUT)

    def bounds(batches):
        for batch in batches:
            at = batch.column("id").to_numpy()
            found = [np.partition((_distances(pivots, pivots[own[i]])[:, None] + close).ravel(), k)[k] if close.size > k else np.inf for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.array(found, float))], ["id", "bound"])

    spread = spark.range(0, len(own), 1, min(len(own), buckets(spark))).mapInArrow(bounds, "id long, bound double").toArrow()
    bound = np.zeros(len(own))
    bound[spread.column("id").to_numpy()] = spread.column("bound").to_numpy()
    bound += 2 * radius[own]  # of the k-th neighbour, and once more for the way from the pivot to a query
    bound += 1e-9 * (1 + np.where(np.isfinite(bound), bound, 0))
    # Groups of cells: each cell of queries joins the nearest of some of them.
    seeds = pivots[own[: math.isqrt(len(own) - 1) + 1]]
    group = np.argmin(np.stack([_distances(seeds, p) for p in pivots[own]]), axis=1)
    group = np.unique(group, return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    own, bound, group = own[order], bound[order], group[order]
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    blocks = -(-np.add.reduceat(asked[own], begin) // GROUP)  # tasks' worth of queries in each group
    first = np.concatenate(([0], np.cumsum(blocks)))
    group_of = np.full(len(pivots), -1)
    group_of[own] = group
    shares = max(1, -(-buckets(spark) // int(first[-1])))  # of a group's data

    def blob(ids: np.ndarray, x: np.ndarray) -> bytes:
        return b"".join((np.int64(len(ids)).tobytes(), ids.tobytes(), x.astype(wire).tobytes()))

    def replicate(batches):
        waiting: dict[int, list] = {}
        size = 0
        for batch in batches:
            ids, cell, d, x = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy(), batch.column("d").to_numpy(), _matrix(batch.column("v"))
            rows = []
            asks = np.flatnonzero(ids % every == 0)
            g = group_of[cell[asks]]
            block = first[g] + place(mix(ids[asks].astype(np.uint64)), 1 << 30).astype(np.int64) % blocks[g]
            for b in np.unique(block):
                mine = asks[block == b]
                raw = blob(ids[mine], x[mine])
                rows += [(int(b) * shares + s, 0, raw) for s in range(shares)]
            some, back = np.unique(cell, return_inverse=True)
            low, high = np.zeros((len(some), len(begin))), np.zeros((len(some), len(begin)))
            for i, c in enumerate(some):
                gap = _distances(pivots[own], pivots[c])
                low[i], high[i] = np.minimum.reduceat(gap - bound, begin), np.maximum.reduceat(gap + bound, begin)
            share = place(mix(ids.astype(np.uint64) + np.uint64(1)), shares).astype(np.int64)
            for g in range(len(begin)):
                near = (d >= low[back, g]) & (d <= high[back, g])
                for s in np.unique(share[near]):
                    at = np.flatnonzero(near & (share == s))
                    for b in range(int(first[g]), int(first[g + 1])):
                        waiting.setdefault(b * shares + int(s), []).append((ids[at], x[at]))
                    size += len(at)
            if size > 50_000:
                rows += [(t, 1, blob(np.concatenate([w[0] for w in held]), np.concatenate([w[1] for w in held]))) for t, held in waiting.items()]
                waiting, size = {}, 0
            if rows:
                yield packed_batch(rows)
        if waiting:
            yield packed_batch([(t, 1, blob(np.concatenate([w[0] for w in held]), np.concatenate([w[1] for w in held]))) for t, held in waiting.items()])

    def opened(raw) -> tuple[np.ndarray, np.ndarray]:
        raw = raw.as_buffer()
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        return np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, wire, -1, 8 + 8 * n).reshape(n, -1).astype(np.float64)

    def solve(batches):
        asks: list = []
        best = None

        def ready():
            ids, x = (np.concatenate([a[i] for a in asks]) for i in (0, 1))
            return [ids, x, (x**2).sum(1), np.full(len(ids), np.inf), [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]

        def meet(ids: np.ndarray, x: np.ndarray) -> None:
            query, q, square, edge, top = best
            own_square = (x**2).sum(1)
            for lo in range(0, len(x), 4096):
                some, n2 = x[lo : lo + 4096], own_square[lo : lo + 4096]
                step = max(1, 4_000_000 // len(some))
                found: list = []
                for a in range(0, len(q), step):
                    rough = square[a : a + step, None] + n2 - 2 * q[a : a + step] @ some.T
                    limit = edge[a : a + step] ** 2
                    if len(some) > 2 * k:  # of a block only its own k + 1 least can count
                        limit = np.minimum(limit, np.partition(rough, k, axis=1)[:, k])
                    row, col = np.nonzero(rough <= (limit + 1e-9 * (1 + square[a : a + step] + np.where(np.isfinite(limit), limit, 0)))[:, None])
                    row += a
                    found.append((row, col))
                row, col = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                keep = query[row] != ids[lo + col]
                row, col = row[keep], col[keep]
                d = np.sqrt(((q[row] - some[col]) ** 2).sum(1))
                row, other, d = np.concatenate((top[0], row)), np.concatenate((top[1], ids[lo + col])), np.concatenate((top[2], d))
                order = np.lexsort((other, d, row))
                row, other, d = row[order], other[order], d[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                last = rank == k - 1
                edge[row[last]] = d[last]
                top[:] = [v[rank < k] for v in (row, other, d)]

        for batch in batches:
            for kind, raw in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                if kind == 0:  # the queries come first
                    asks.append(opened(raw))
                elif asks:
                    best = best or ready()
                    meet(*opened(raw))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(best[0][best[4][0]]), pa.array(best[4][1]), pa.array(best[4][2])], ["vec_id", "neighbor_id", "distance"])

    tasks = cells.mapInArrow(tidy(replicate), PACKED).repartitionById(int(first[-1]) * shares, F.col("bucket")).sortWithinPartitions("kind")
    partial = tasks.mapInArrow(tidy(solve), "vec_id long, neighbor_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbor_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "neighbor_id", "rank", "distance")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=EVERY).withColumn("distance", F.round("distance", 6))


SQL = """
WITH e AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings GROUP BY vec_id),
d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT vec_id, neighbor_id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM r WHERE rank <= 10
"""
