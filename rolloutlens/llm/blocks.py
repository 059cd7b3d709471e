"""Texts packed into blocks: rows of some megabytes that are written once, compressed, and joined by name instead of by document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rolloutlens.llm.common import as_bytes, id_and_text, slices

#: Text bytes of a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
SCHEMA = "block long, size long, dids binary, sizes binary, texts binary"


def blocks_of(docs: DataFrame, first: int = 0) -> DataFrame:
    """Rows of SCHEMA with all of ``docs``. Write the result before use: a block's name is its place in the scan, with ``first`` (below 2 ** 15) in front."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held, size = (first << 48) + (TaskContext.get().partitionId() << 24), [], 0

        def flush() -> pa.RecordBatch:
            texts = b"".join(t for _, t in held)
            row = [turn, len(texts), np.array([d for d, _ in held], np.int64).tobytes(), np.array([len(t) for _, t in held], np.int64).tobytes(), pa.compress(texts, codec="zstd", asbytes=True)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["block", "size", "dids", "sizes", "texts"])

        for batch in slices(batches):
            for did, text in zip(batch.column("did").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if held and size + len(text) > BLOCK_BYTES:
                    yield flush()
                    turn, held, size = turn + 1, [], 0
                held.append((did, text))
                size += len(text)
        if held:
            yield flush()

    return id_and_text(docs).mapInArrow(pack, SCHEMA)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def dids_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["dids"], np.int64)


def texts_of(row: dict) -> Iterator[bytes]:
    """The texts of a block (a row of SCHEMA as a dict), in the order of ``dids_of``."""
    texts = pa.decompress(row["texts"], decompressed_size=row["size"], codec="zstd", asbytes=True) if row["size"] else b""
    at = 0
    for n in np.frombuffer(row["sizes"], np.int64).tolist():
        yield texts[at : at + n]
        at += n
