"""Shared helpers: scratch tables in the shared folder, batches of bounded size, words and shingles.

Words are the maximal runs of bytes other than space and 0x09-0x0D, which is what ``bytes.split()`` gives.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step inside a task works on at a time.
SLICE_BYTES = 4 << 20
#: Stands for a null doc_id inside the operators; it sorts first.
NULL_ID = -(1 << 63)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only if the session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = tempfile.mkdtemp(prefix="rolloutlens-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_files(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        folders = {table} if isinstance(table, str) else {f.rpartition("/")[0] for f in table.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(docs: DataFrame) -> DataFrame:
    """(did, text): did is doc_id with null as NULL_ID; a null text is empty. All other columns are left aside."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs that nothing refers to any more, instead of at its next garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def own_shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes inside the block delete their own shuffle files as soon as they are done."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def real_id(column: str = "did") -> F.Column:
    return F.nullif(F.col(column), F.lit(NULL_ID))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``size`` bytes in ``column``; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of ``n`` word hashes, in order; empty if there are fewer words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m] * _ODD[0]
    for j in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _ODD[j % len(_ODD)] + h[j : j + m]
    return mix(out + np.uint64(n))


def shingle_set(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text with A-Z lower-cased; fewer words make one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(ngrams(word_hashes(words), min(n, len(words))))


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, all first bytes first, so that high bytes compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()
