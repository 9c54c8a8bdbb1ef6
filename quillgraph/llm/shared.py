"""What the operators of this subpackage share: sessions, kept tables, samples and packed exchanges."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
_kept: list[tuple[SparkSession, str]] = []


try:  # glibc: large arrays go back to the system when they are freed, and Arrow's buffers with them
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-3, 8 << 20)
    pa.set_memory_pool(pa.system_memory_pool())
except (OSError, AttributeError):
    _libc = None


def tidy(each: Callable) -> Callable:
    """A function over batches that gives back its worker's free memory at the end: workers outlive tasks."""

    @functools.wraps(each)
    def wrapped(batches):
        yield from each(batches)
        release()

    return wrapped


def release() -> None:
    if _libc is not None:
        _libc.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset (tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _kept:
        atexit.register(_sweep)
    _kept.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """kept(df), whose own exchanges' files go from disk when it is written, not when the driver next collects its garbage."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return kept(df)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def kept_so_far() -> int:
    return len(_kept)


def drop_kept(since: int) -> None:
    """Deletes the tables kept since then, but for the last, into which they have gone."""
    for spark, path in _kept[since:-1]:
        _delete(spark, path)
    del _kept[since:-1]


def _sweep() -> None:
    for spark, path in _kept:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended already; its folder is not ours to keep
            return


def buckets(spark: SparkSession) -> int:
    """Parts of a packed exchange: spark.sql.shuffle.partitions, which is to follow the size of the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows that have a doc_id; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")


def sample_ids(ids: DataFrame, n: int, salt: str) -> DataFrame:
    """At most n of the distinct values of ids' only column, the same ones every time: those with the least hashes."""
    name = ids.columns[0]
    rank = F.xxhash64(F.col(name), F.lit(salt))
    total = ids.agg(F.approx_count_distinct(name)).first()[0]
    if total > 4 * n + 200:  # a prefilter on the hash, so that no task sorts the whole column; what it spares exceeds n all but surely
        ids = ids.where(F.pmod(rank, F.lit(1 << 20)) < int((1 << 20) * (2 * n + 50) / total) + 1)
    return ids.distinct().orderBy(F.pmod(rank, F.lit(1 << 20)), F.col(name)).limit(n)


# Packed exchange: entries travel as blobs of numpy columns, one blob a bucket and flush, not as rows. Values of one
# column are contiguous inside a blob, so the shuffle codec shrinks what repeats, and the JVM handles few objects.

PACKED = "bucket int, kind int, blob binary"
FLUSH = 3_000_000


def split48(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low 48 bits as a 32-bit and a 16-bit column."""
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((key >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)


def join48(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def place(value: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a 64-bit value."""
    return ((value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)


def packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "blob"])


class Packer:
    """Collects entries of the given column types and gives them out, by bucket, as batches of PACKED."""

    def __init__(self, n: int, kinds: str, kind: int = 0, zipped: bool = False) -> None:
        """zipped: blobs are compressed, by a code that spares single bits where the shuffle's spares repeated bytes alone."""
        self.n, self.types, self.kind, self.zipped, self.size, self.parts = n, [np.dtype(k) for k in kinds.split()], kind, zipped, 0, []

    def add(self, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.parts.append((bucket.astype(np.uint16 if self.n <= 65536 else np.uint32), *(c.astype(t, copy=False) for c, t in zip(columns, self.types, strict=True))))
            self.size += len(bucket)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        bucket, *columns = (np.concatenate([p[i] for p in self.parts]) for i in range(len(self.types) + 1))
        self.parts, self.size = [], 0
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=self.n))
        columns = [c[order] for c in columns]
        rows, at = [], 0
        for b, end in enumerate(ends.tolist()):
            if end > at:
                body = [c[at:end].tobytes() for c in columns]
                if self.zipped:
                    body = [_codec().compress(b"".join(body), asbytes=True)]
                rows.append((b, self.kind, b"".join([np.int64(end - at).tobytes(), *body])))
                at = end
        yield packed_batch(rows)


@functools.cache
def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def unpacked(blobs: list, kinds: str, zipped: bool = False) -> list[np.ndarray]:
    """The columns of all the given blobs, one after another."""
    types = [np.dtype(k) for k in kinds.split()]
    parts: list[list] = [[] for _ in types]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        if zipped:
            blob, at = _codec().decompress(memoryview(blob)[8:], n * sum(t.itemsize for t in types)), 0
        for part, t in zip(parts, types, strict=True):
            part.append(np.frombuffer(blob, t, n, at))
            at += n * t.itemsize
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, types, strict=True)]


def exchanged(df: DataFrame, n: int) -> DataFrame:
    """Each bucket in a partition of its own."""
    return df.repartitionById(n, F.col("bucket"))


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list]:
    """A bucket's blobs by kind."""
    found: dict[int, list] = {}
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
            found.setdefault(kind, []).append(blob.as_buffer())
    return found


def runs(sorted_key: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values: the first index of each, and the length at the end."""
    if not len(sorted_key):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_key[1:] != sorted_key[:-1]) + 1, [len(sorted_key)]))


def repeated(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The entries whose key occurs more than once, keys in order. Most keys occur once; this drops them cheaply."""
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    keep = np.zeros(len(key), bool)
    keep[1:] = same
    keep[:-1] |= same
    order = order[keep]
    return key[keep], *(c[order] for c in columns)
