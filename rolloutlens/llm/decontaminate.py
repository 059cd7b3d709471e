"""Benchmark decontamination: short test items inside long documents.

Containment search by MinHash, partitioned by size: items fall into classes by their number of five-word shingles, and for each class
a document is a row of overlapping windows twice as large as the class's largest item, so that an item and the window that holds it
have a Jaccard similarity of 0.19 or more at a containment of 0.8 (from four shingles on). With bands of one row and PERMUTATIONS bands, a window that holds such an
item is missed with a probability under 0.81 ** PERMUTATIONS (one in 25,000). Items of up to FEW shingles are found by their first shingle, exactly: at 0.8 all of
them must be there. Every candidate is verified by exact containment in the whole document. Items with equal sets are looked for once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloutlens.llm.common import as_bytes, id_and_text, mix, ngrams, real_id, shingle_set, slices, word_hashes, written

PERMUTATIONS, LEAST_CLASS = 48, 8
#: Items of so few shingles are looked up shingle by shingle instead.
FEW = 3
#: Shingles of the items that one pass over the documents looks for; more items take more passes.
BLOCK_SHINGLES = 2_000_000
_FACTORS = np.random.default_rng(20).integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class ItemIndex:
    """MinHash keys of a block of items by size class, their exact shingle sets, and the first shingles of the shortest items."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], percent: int):
        by_set: dict[bytes, list[int | None]] = {}
        for name, shingles in items:
            by_set.setdefault(shingles.tobytes(), []).append(name)
        #: (names of the items with this set, set)
        self.items = [(names, np.frombuffer(raw, np.uint64)) for raw, names in by_set.items()]
        by_class: dict[int, list[int]] = {}
        few: list[tuple[int, int]] = []
        for k, (_, shingles) in enumerate(self.items):
            if len(shingles) <= FEW and 100 * (len(shingles) - 1) < percent * len(shingles):
                few.append((int(shingles[0]), k))
            else:
                by_class.setdefault(max(LEAST_CLASS, 1 << (len(shingles) - 1).bit_length()), []).append(k)
        #: sorted first shingles, their items
        self.few = tuple(np.array(x, t) for x, t in zip(zip(*sorted(few), strict=True), (np.uint64, np.int64), strict=True)) if few else None
        #: class -> for each permutation (sorted keys, their items)
        self.classes = {}
        for size, members in sorted(by_class.items()):
            keys = np.array([[mix(self.items[k][1] * f).min() for k in members] for f in _FACTORS])
            order = np.argsort(keys, axis=1, kind="stable")
            self.classes[size] = (np.take_along_axis(keys, order, axis=1), np.array(members)[order])

    def candidates(self, shingles: np.ndarray, lengths: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs that share a key; ``shingles`` are those of the documents one after another, all of them in reading order."""
        out: set[tuple[int, int]] = set()
        offsets = np.cumsum(lengths) - lengths
        full = np.flatnonzero(lengths)
        if not len(full):
            return out
        if self.few:
            out.update(_met(shingles, np.repeat(np.arange(len(lengths)), lengths), *self.few))
        for size, (keys, members) in self.classes.items():
            blocks = -(-lengths[full] // size)
            owner = np.repeat(full, blocks)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts = offsets[owner] + within * size
            joined = owner[1:] == owner[:-1]
            for p, factor in enumerate(_FACTORS):
                low = np.minimum.reduceat(mix(shingles * factor), starts)
                low[:-1][joined] = np.minimum(low[:-1], low[1:])[joined]
                out.update(_met(low, owner, keys[p], members[p]))
        return out


def _met(values: np.ndarray, owners: np.ndarray, keys: np.ndarray, members: np.ndarray) -> set[tuple[int, int]]:
    """(owner, member) for each value that is among the sorted keys, with all members of that key."""
    first = np.searchsorted(keys, values)
    hit = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == values)
    count = np.searchsorted(keys, values[hit], "right") - first[hit]
    at = np.repeat(first[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())
    return set(zip(np.repeat(owners[hit], count).tolist(), members[at].tolist(), strict=True))


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(item_id, shingles, n): the distinct five-word shingles of each item; items without words are left out, as nothing can hold them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x) for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["item_id", "shingles", "n"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return items.mapInArrow(cut, "item_id long, shingles binary, n long").where("n > 0")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_common) where a document holds ``percent`` of an item's distinct shingles or more.

    Null and empty texts hold nothing and are held by nothing; a text of fewer than five words is one shingle; repeated rows and
    items come out each; null ids stay null; without documents or items there are no rows.
    """
    items = written(item_shingles(benchmark), "items")
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # dealt by hash, so no task sees all items; a block has about BLOCK_SHINGLES
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("shingles"), F.lit(blocks)))
    return reduce(DataFrame.unionAll, [_one_block(docs, dealt.where(F.col("block") == b), percent) for b in range(blocks)])


def _one_block(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    rows = [(r["item_id"], np.frombuffer(r["shingles"], np.uint64)) for r in items.select("item_id", "shingles").collect()]  # about BLOCK_SHINGLES
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex(rows, percent))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = index.value
        for batch in slices(batches):
            texts = [x.lower().split() for x in as_bytes(batch.column("text"))]
            grams = [ngrams(word_hashes(w), min(5, len(w))) if w else np.zeros(0, np.uint64) for w in texts]
            ids, out, sets = batch.column("did").to_pylist(), [], {}
            for doc, item in sorted(look.candidates(np.concatenate(grams), np.fromiter(map(len, grams), np.int64, len(grams)))):
                if doc not in sets:
                    sets = {doc: np.unique(grams[doc])}
                names, wanted = look.items[item]
                held, at = sets[doc], np.searchsorted(sets[doc], wanted)
                common = int((held[np.minimum(at, len(held) - 1)] == wanted).sum())
                if 100 * common >= percent * len(wanted):
                    out += [(ids[doc], name, len(wanted), common) for name in names]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["did", "item_id", "n_item_shingles", "n_common"])

    found = id_and_text(docs).mapInArrow(search, "did long, item_id long, n_item_shingles long, n_common long")
    return found.select(real_id().alias("doc_id"), "item_id", "n_item_shingles", "n_common")
