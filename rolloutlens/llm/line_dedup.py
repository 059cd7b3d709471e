"""Removal of multi-line passages that repeat anywhere in the corpus.

A rolling hash over the hashes of neighbouring lines chooses where a chunk ends, so a passage is cut alike wherever it stands. Chunks of
two lines or more whose 128-bit key repeats are compared byte for byte; of equal chunks the first, by doc_id and place, stays. Keys are
counted with partial sums, so that a very common chunk costs each task one row. ``line_dedup`` cuts these copies out and nothing else.

``passage_dedup`` goes on from there, because a short passage seldom holds a whole chunk. Its matches grow line by line beyond the copies
and between them: of the lines outside of copied chunks it takes each window, a run with exactly two lines that hold a word. Windows whose
64-bit key repeats are compared byte for byte; of equal windows the first stays. A window inside a copied chunk needs no look of its own:
the chunk's first copy holds the same one earlier, and chunks don't overlap. So all windows that repeat go, wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from rolloutlens.llm.common import NULL_ID, drop_files, ngrams, own_shuffles_dropped, slices, word_hashes, written

#: Lines that the rolling hash spans, one line in so many ends a chunk, and lines of a chunk at least.
SPAN, DIVISOR, LEAST_LINES = 2, 3, 2


def chunk_bounds(lines: list[bytes]) -> list[tuple[int, int]]:
    """[first, end) of the chunks, in order; they cover all lines."""
    rolling = ngrams(word_hashes(lines), SPAN)
    ends = np.flatnonzero(rolling % np.uint64(DIVISOR) == 0) + SPAN
    bounds, start = [], 0
    for end in ends.tolist():
        if end - start >= LEAST_LINES:
            bounds.append((start, end))
            start = end
    return bounds + [(start, len(lines))] * (start < len(lines))


def _multi_line(raw: bytes) -> list[tuple[int, int, int, bytes]]:
    """(chunk number, first line with a word, end of the last one, bytes) of chunks with two lines that hold a word, or more."""
    lines = raw.split(b"\n")
    full = [(k, [i for i in range(a, b) if lines[i].strip()], b"\n".join(lines[a:b])) for k, (a, b) in enumerate(chunk_bounds(lines))]
    return [(k, x[0], x[-1] + 1, body) for k, x, body in full if len(x) >= LEAST_LINES]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for did, th, text in zip(batch.column("did").to_pylist(), batch.column("th").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            for k, _, _, chunk in _multi_line(text):
                out.append((did, th, k, xxhash.xxh3_128_digest(chunk)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["did", "th", "chunk", "key"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for did, th, text, chunks in zip(batch.column("did").to_pylist(), batch.column("th").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("chunks").to_pylist(), strict=True):
            wanted = set(chunks)
            out += [(did, th, *chunk) for chunk in _multi_line(text) if chunk[0] in wanted]
        if out:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["did", "th", "chunk", "first", "end", "body"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, counts = [], []
        for text, chunks in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("chunks").to_pylist(), strict=True):
            lines, gone = (text.split(b"\n") if text else []), set(chunks or ())
            kept = lines
            if gone:
                kept = [x for k, (a, b) in enumerate(chunk_bounds(lines)) if k not in gone for x in lines[a:b]]
            texts.append(b"\n".join(kept))
            counts.append((len(lines), len(lines) - len(kept), len(gone)))
        total, lost, chunks = (pa.array(x, pa.int64()) for x in zip(*counts, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column("other"), pa.array(texts, pa.binary()).cast(pa.string()), total, lost, chunks], ["other", "text", "n_lines", "n_removed_lines", "n_removed_chunks"])


#: The columns that both forms add; of the same names in the input, these stand.
_ADDED = ("n_lines", "n_removed_lines", "n_removed_chunks")


def _schema(other: DataType) -> StructType:
    return StructType([StructField("other", other), StructField("text", StringType()), *[StructField(c, LongType()) for c in _ADDED]])


def chunk_copies(slim: DataFrame, keys: DataFrame) -> DataFrame:
    """(did, th, chunk, first, end) of the chunks that have an equal one before them; [first, end) are the lines from the chunk's first with a word to its last.

    ``slim`` has did, th and text, ``keys`` did, th, chunk and key of the chunks with two lines or more.
    """
    repeated = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    suspects = keys.join(repeated, "key").groupBy("did", "th").agg(F.collect_set("chunk").alias("chunks"))
    bodies = written(slim.join(suspects, ["did", "th"]).mapInArrow(_candidates, "did long, th long, chunk int, first int, end int, body binary"), "chunk-bodies")
    place = F.struct("did", "th", "chunk")
    firsts = bodies.groupBy("body").agg(F.min(place).alias("kept"))
    return bodies.join(firsts, "body").where(place > F.col("kept")).select("did", "th", "chunk", "first", "end").distinct()


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with repeated chunks cut out of text, and n_lines, n_removed_lines, n_removed_chunks.

    A null text comes out empty; a null doc_id sorts first; of rows with one doc_id the text's hash decides which is first, and
    rows equal in both are one document, which isn't its own repetition. The removed chunks' line feeds go with them. Columns of docs named as the
    added ones are replaced by them.
    """
    docs = docs.drop(*_ADDED)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("other"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("th", F.xxhash64("text"))
    slim = rows.select("did", "th", "text")
    keys = written(slim.where(F.contains("text", F.lit("\n"))).mapInArrow(_keys, "did long, th long, chunk int, key binary"), "chunk-keys")
    gone = chunk_copies(slim, keys).groupBy("did", "th").agg(F.collect_set("chunk").alias("chunks"))
    cut = rows.join(gone, ["did", "th"], "left").select("other", "text", "chunks")
    schema = _schema(rows.schema["other"].dataType)
    done = cut.mapInArrow(_cut, schema)
    return done.select(*[F.col("other").getField(c).alias(c) if c != "text" else F.col("text") for c in docs.columns], *_ADDED)


def windows(lines: list[bytes]) -> list[tuple[int, int]]:
    """[first, end) of the runs that start and end with a line that holds a word and have LEAST_LINES of them."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return [(a, b + 1) for a, b in zip(full, full[LEAST_LINES - 1 :], strict=False)]


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window; chunk is -1 if it reaches over the end of one, and the first window inside a chunk has the chunk's key."""
    for batch in slices(batches):
        parts, chunk_keys = [], []
        for did, th, text in zip(batch.column("did").to_pylist(), batch.column("th").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            lines = text.split(b"\n")
            bounds = windows(lines)
            if bounds:
                n, chunks = len(bounds), chunk_bounds(lines)
                first, end = np.array(bounds, np.int32).T
                of_line = np.repeat(np.arange(len(chunks), dtype=np.int32), [b - a for a, b in chunks])
                chunk = np.where(of_line[first] == of_line[end - 1], of_line[first], np.int32(-1))
                keys = np.fromiter((xxhash.xxh3_64_intdigest(b"\n".join(lines[a:b])) for a, b in bounds), np.uint64, n).view(np.int64)
                whole = dict(zip(*(x.tolist() for x in np.unique(chunk, return_index=True)[::-1]), strict=True))
                chunk_keys += [xxhash.xxh3_128_digest(b"\n".join(lines[slice(*chunks[whole[i]])])) if whole.get(i, -1) >= 0 else None for i in range(n)]
                parts.append((np.full(n, did, np.int64), np.full(n, th, np.int64), first, chunk, keys))
        if parts:
            yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], pa.array(chunk_keys, pa.binary())], ["did", "th", "first", "chunk", "key", "chunk_key"])


def _window_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for did, th, text, firsts in zip(batch.column("did").to_pylist(), batch.column("th").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("firsts").to_pylist(), strict=True):
            lines, wanted = text.split(b"\n"), set(firsts)
            out += [(did, th, a, b, b"\n".join(lines[a:b])) for a, b in windows(lines) if a in wanted]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["did", "th", "first", "end", "body"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, counts = [], []
        for text, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines = text.split(b"\n") if text else []
            cut = np.zeros(len(lines) + 1, bool)
            for w in gone or ():
                cut[w["first"] : w["end"]] = True
            texts.append(b"\n".join([x for x, c in zip(lines, cut.tolist(), strict=False) if not c]))
            counts.append((len(lines), int(cut.sum()), int((cut[1:] < cut[:-1]).sum())))
        total, lost, runs = (pa.array(x, pa.int64()) for x in zip(*counts, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column("other"), pa.array(texts, pa.binary()).cast(pa.string()), total, lost, runs], ["other", "text", "n_lines", "n_removed_lines", "n_removed_chunks"])


def passage_dedup(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with repeated passages cut out of text, and n_lines, n_removed_lines, n_removed_chunks (runs of removed lines).

    A window goes if an equal one comes before it, by document and place, and doesn't overlap it; so the first copy of each line stays.
    Copied chunks go first, as in line_dedup; the windows of all other lines are compared one by one. Each write deletes its own shuffle
    files, so one shuffle of the texts at a time is on disk, and tables that nothing reads any more are deleted.
    Nulls, repeated rows and line feeds are as in line_dedup. Blank lines go only between removed lines.
    """
    docs = docs.drop(*_ADDED)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("other"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("th", F.xxhash64("text"))
    slim = rows.select("did", "th", "text")
    with own_shuffles_dropped(docs.sparkSession):
        cuts = written(slim.where(F.contains("text", F.lit("\n"))).mapInArrow(_cuts, "did long, th long, first int, chunk int, key long, chunk_key binary"), "line-cuts")
        named = cuts.where("chunk_key is not null").select("did", "th", "chunk", F.col("chunk_key").alias("key"))
        copies = written(chunk_copies(slim, named), "chunk-copies")
        keys = cuts.join(copies, ["did", "th", "chunk"], "left_anti").select("did", "th", "first", "key")
        repeated = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        suspects = keys.join(repeated, "key").groupBy("did", "th").agg(F.collect_set("first").alias("firsts"))
        bodies = written(slim.join(suspects, ["did", "th"]).mapInArrow(_window_bodies, "did long, th long, first int, end int, body binary"), "window-bodies")
        kept = bodies.groupBy("body").agg(F.min(F.struct("did", "th", "first", "end")).alias("kept"))
        same = (F.col("did") == F.col("kept.did")) & (F.col("th") == F.col("kept.th"))
        grown = bodies.join(kept, "body").where(~same | (F.col("first") >= F.col("kept.end"))).select("did", "th", "first", "end")
        gone = written(grown.unionAll(copies.select("did", "th", "first", "end")).groupBy("did", "th").agg(F.collect_set(F.struct("first", "end")).alias("gone")), "gone")
    drop_files(docs.sparkSession, cuts)
    schema = _schema(rows.schema["other"].dataType)
    # merged at every size: no broadcast that grows with the corpus
    done = rows.join(gone.hint("merge"), ["did", "th"], "left").select("other", "text", "gone").mapInArrow(_without, schema)
    return done.select(*[F.col("other").getField(c).alias(c) if c != "text" else F.col("text") for c in docs.columns], *_ADDED)
