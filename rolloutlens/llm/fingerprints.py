"""Fingerprints of documents by consistent weighted sampling (Ioffe 2010).

A text's terms are its words, weighted by how often they occur; a word of more than LONG_WORD bytes counts as its runs of eight bytes, so that text without spaces has terms too.
For sample j a term k has numbers of its own, drawn by hash: r and c from gamma(2, 1) and b from (0, 1). With weight w its level is t = floor(ln w / r + b), and its value
ln c - r (t - b) - r is the logarithm of an exponential variable of rate w. The sample's signature is (k, t) of the least value. Two texts have the same signature with a
probability that equals their generalised Jaccard similarity: the sum of the smaller weights over the sum of the larger ones.

Terms are known by 64 bits of hash, values are compared as 32-bit floats (ties: the smaller signature), and a fingerprint keeps 16 bits of each signature, so unlike texts agree
by chance in one sample of 65,536. A text without words has the empty fingerprint, which is like itself only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloutlens.llm.common import SLICE_BYTES, as_bytes, id_and_text, mix, real_id, slices, written

SAMPLES = 64
LONG_WORD = 32
#: Terms that one step works on, so that its arrays stay in a core's cache.
_STEP = 1 << 14
_UNIT = 2.0**-32


class WordHashes(dict):
    """Hashes by word, found once for the texts that are worked on together."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def terms(text: bytes, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a text's distinct terms, and how often each occurs."""
    words = text.split()
    long = [w for w in words if len(w) > LONG_WORD] if words and max(map(len, words)) > LONG_WORD else []
    if long:
        words = [w for w in words if len(w) <= LONG_WORD]
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if long:
        runs = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(w, np.uint8), 8).copy().view(np.uint64).ravel() for w in long]
        hashes = np.concatenate([hashes, *[mix(x + np.uint64(8)) for x in runs]])
    hashes.sort()
    ends = np.flatnonzero(np.append(hashes[1:] != hashes[:-1], True)[: len(hashes)])
    return hashes[ends], np.diff(ends, prepend=-1)


def _uniforms(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers from (0, 1) of each hash: its upper and its lower half."""
    return ((h >> np.uint64(32)).astype(np.float64) + 0.5) * _UNIT, ((h & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * _UNIT


def draws(term: np.ndarray, log_weight: np.ndarray, j: int) -> np.ndarray:
    """For sample j, a number for each (term, weight): its value in the upper 32 bits, in an order that sorts as a whole number, its signature in the lower."""
    seed = mix(term + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    third = mix(seed + np.uint64(2))
    u, v = _uniforms(seed)
    r = -np.log(u * v)
    u, v = _uniforms(mix(seed + np.uint64(1)))
    log_c = np.log(-np.log(u * v))
    b = _uniforms(third)[0]
    level = np.floor(log_weight / r + b)
    bits = (log_c - r * (level - b + 1)).astype(np.float32).view(np.uint32)
    ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
    signature = mix(third + level.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    return ordered << np.uint64(32) | signature


def signatures(texts: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """16-bit signatures, a row for each text; rows of texts without terms are zero. Each (term, weight) of the texts is drawn once."""
    out = np.zeros((len(texts), samples), np.uint16)
    known = WordHashes()
    found = [terms(t, known) for t in texts]
    sizes = np.array([len(h) for h, _ in found], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    names, weights = (np.concatenate([found[k][i] for k in full]) for i in (0, 1))
    pairs = np.stack([names, weights.astype(np.uint64)], axis=1)
    order = np.lexsort((weights, names))
    pairs = pairs[order]
    new = np.concatenate([[True], np.any(pairs[1:] != pairs[:-1], axis=1)])
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    term, log_weight = pairs[new, 0], np.log(pairs[new, 1].astype(np.float64))
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    drawn = np.empty(len(term), np.uint64)
    for j in range(samples):
        for a in range(0, len(term), _STEP):
            drawn[a : a + _STEP] = draws(term[a : a + _STEP], log_weight[a : a + _STEP], j)
        out[full, j] = (np.minimum.reduceat(drawn[at], starts) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _named(rows: np.ndarray, texts: list[bytes]) -> list[str]:
    return [row.astype(">u2").tobytes().hex() if text.split() else "" for row, text in zip(rows, texts, strict=True)]


def same(a: str, b: str) -> float:
    """The share of samples in which two fingerprints agree."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint16) for s in (a, b))
    return float((x == y).mean())


def likeness(a: str, b: str) -> Column:
    """``same`` as an expression over two columns of fingerprints."""
    places = F.sequence(F.lit(0), (F.length(a) / 4 - 1).cast("int"))
    cells = F.size(F.filter(places, lambda i: F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4))))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), (F.col(a) == F.col(b)).cast("double")).otherwise(cells / (F.length(a) / 4))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of each row of ``docs``, which takes no shuffle; a null text is empty, null and repeated ids keep their rows, other columns are left aside."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(_named(signatures(texts, samples), texts), pa.string())], ["did", "fingerprint"])

    return id_and_text(docs).mapInArrow(sign, "did long, fingerprint string").select(real_id().alias("doc_id"), "fingerprint")


def _starts(text: bytes) -> np.ndarray:
    """Where the code points of a text begin: at each byte that continues none."""
    return np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """The text's code points, and the text with its last quarter (rounded down) replaced by as many code points of the beginning of ``following``, or all that it has."""
    at = _starts(text)
    cut = len(at) // 4
    if not cut:
        return len(at), text
    new = _starts(following)
    return len(at), text[: at[len(at) - cut]] + (following[: new[cut]] if cut < len(new) else following)


_ROWS = "did long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(run: list[tuple[int, bytes]], samples: int) -> tuple[list[tuple], list[str]]:
    """For documents in order: rows of _ROWS for all but the last, and the fingerprints of all."""
    texts = [t for _, t in run]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    every = texts + [t for _, t in changed]
    names = _named(signatures(every, samples), every)
    own, other = names[: len(texts)], names[len(texts) :]
    rows = [
        (run[k][0], n, hashlib.sha256(new).hexdigest(), own[k], other[k], same(own[k], other[k]), same(own[k], own[k + 1]))
        for k, (n, new) in enumerate(changed)
    ]
    return rows, own


def edit_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each document beside its edited text and the next document: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last quarter of the code points replaced by the beginning of the next document's. Documents are in the order of doc_id, null first, and equal ids in that of
    their texts' hashes, then texts; after the last comes the first, so a single document is its own next one. A null text is empty. Other columns are left aside.

    Texts are shuffled once, by ranges of the order. A task works on runs of neighbours of some megabytes. The last document of a task has its neighbour in the next task that has rows:
    these (two texts a task) are written and joined afterwards.
    """
    spark = docs.sparkSession

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, size, begun = TaskContext.get().partitionId(), [], 0, False

        def emit(rows: list[tuple], kind: int, text: bytes | None = None) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            extra = [pa.array([part] * len(rows), pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([text] * len(rows), pa.binary())]
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], *extra], [*[f.split()[0] for f in _ROWS.split(", ")], "part", "kind", "text"])

        for batch in slices(batches):
            for did, text in zip(batch.column("did").to_pylist(), as_bytes(batch.column("text")), strict=True):
                run.append((did, text))
                size += len(text)
                if size > SLICE_BYTES and len(run) > 1:
                    rows, own = _judged(run, samples)
                    if not begun:
                        yield emit([(run[0][0], None, None, own[0], None, None, None)], 1, run[0][1])
                        begun = True
                    yield emit(rows, 0)
                    run, size = run[-1:], len(text)
        if run:
            rows, own = _judged(run, samples)
            if not begun:
                yield emit([(run[0][0], None, None, own[0], None, None, None)], 1, run[0][1])
            if rows:
                yield emit(rows, 0)
            yield emit([(run[-1][0], None, None, own[-1], None, None, None)], 2, run[-1][1])

    ordered = id_and_text(docs).withColumn("th", F.xxhash64("text")).repartitionByRange("did", "th").sortWithinPartitions("did", "th", "text").select("did", "text")
    told = written(ordered.mapInArrow(tell, f"{_ROWS}, part int, kind int, text binary"), "fingerprints")
    parts = sorted(r["part"] for r in told.where("kind = 1").select("part").collect())  # a number for each task
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, follower int")
    firsts = told.where("kind = 1").select(F.col("part").alias("follower"), F.col("text").alias("following"))
    pairs = told.where("kind = 2").select("did", "text", "part").join(follows, "part").join(firsts, "follower").select("did", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for did, *texts in zip(batch.column("did").to_pylist(), as_bytes(batch.column("text")), as_bytes(batch.column("following")), strict=True):
                rows, _ = _judged([(did, texts[0]), (did, texts[1])], samples)
                yield pa.RecordBatch.from_pylist([dict(zip((f.split()[0] for f in _ROWS.split(", ")), rows[0], strict=True))])

    names = [f.split()[0] for f in _ROWS.split(", ")]
    both = told.where("kind = 0").select(*names).union(pairs.mapInArrow(finish, _ROWS))
    return both.select(real_id().alias("doc_id"), *names[1:])
