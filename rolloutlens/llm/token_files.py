"""Token ids as Parquet list columns, for selective reads of tokens and of metadata.

Layout: files in ascending doc_id order; ``tokens`` is dictionary-coded (16 bits or fewer an id), the integer columns
are delta-coded (Parquet format 2), row groups and pages have bounded sizes, and column and offset indexes let a
reader skip pages by doc_id. ``part`` and ``part_start`` place a document among the ids of its file, so that the
ids before it are known from one small table with a row for each file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolloutlens.llm.common import id_and_text, new_path, real_id, slices
from rolloutlens.llm.tokens import encoder

SCHEMA = "did long, part int, part_start long, n_tokens int, tokens array<int>"
_ARROW = pa.schema([("did", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int32()), ("tokens", pa.list_(pa.int32()))])


def encode_documents(docs: DataFrame, tokenizer_path: str, kind: str, end_id: int) -> DataFrame:
    """Rows of SCHEMA in ascending doc_id order: ids of each whole text and then ``end_id``.

    A null or empty text has the end id alone; a null doc_id sorts first; rows with one doc_id are in the order of their texts' hashes, and repeated rows are encoded each.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer_path, kind), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids = enc.ids(batch.column("text").to_pylist())
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) + 1
            ends = np.cumsum(lengths)
            flat = np.full(int(ends[-1]), end_id, np.int32)
            keep = np.ones(len(flat), bool)
            keep[ends - 1] = False
            flat[keep] = np.concatenate(ids)
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), pa.array(np.full(len(ids), part, np.int32)), pa.array(at + ends - lengths), pa.array(lengths.astype(np.int32)), tokens], schema=_ARROW
            )
            at += int(ends[-1])

    rows = id_and_text(docs).withColumn("th", F.xxhash64("text"))
    return rows.repartitionByRange("did", "th").sortWithinPartitions("did", "th").mapInArrow(encode, SCHEMA)


def write_tokens(encoded: DataFrame, path: str, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Write rows of SCHEMA. Spark's committer makes files of lost or repeated tasks invisible."""
    options = {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes,
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": "true", "parquet.dictionary.page.size": 1 << 20,
    }
    encoded.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: tuple[int, int] | None = None, with_tokens: bool = True) -> DataFrame:
    """The files again, of doc_ids from ids[0] to ids[1] if given (pages outside are skipped); without tokens only metadata is read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    files = files.where(F.col("did").between(*ids)) if ids else files
    return files if with_tokens else files.drop("tokens")


def part_starts(files: DataFrame) -> DataFrame:
    """(part, before): ids in the files before. It has a row for each file."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def checksums(files: DataFrame) -> DataFrame:
    """(did, part, part_start, n_tokens, ids_crc32): unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            data = memoryview(tokens.values.to_numpy().astype("<u4", copy=False)).cast("B")
            at = tokens.offsets.to_numpy().astype(np.int64) * 4
            crc = pa.array([zlib.crc32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
            n_tokens = pa.array(np.diff(at) // 4)
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("part"), batch.column("part_start"), n_tokens, crc], ["did", "part", "part_start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(sums, "did long, part int, part_start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer_path: str, kind: str = "words", end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and return what they hold, a row for each document."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "tokens")
    write_tokens(encode_documents(docs, tokenizer_path, kind, end_id), path)
    starts = part_starts(read_tokens(spark, path, with_tokens=False))
    return (
        checksums(read_tokens(spark, path))
        .join(starts, "part")
        .select(real_id().alias("doc_id"), (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
    )
