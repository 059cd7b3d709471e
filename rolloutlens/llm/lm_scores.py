"""Stupid-backoff scores of documents under counts of the whole corpus, the document itself left out.

The join of exploded n-grams with count tables, in packed rows: documents are written in blocks, a block's distinct n-grams go with their counts to
hash partitions, each of which holds one slice of the count table; there the counts are summed and joined to what each block sent, and the totals go back
to the blocks, which look them up for every n-gram of each document and sum. Trigrams are sent after the answers about bigrams, and only those that these don't rule out. Row by row, with a key and a document id for each n-gram, the same join would
shuffle some 16 bytes for each word and order; packed and sorted, an n-gram costs a block about 6 bytes, once.
A very common n-gram is one entry for each block. Texts are compressed and move once.

An n-gram is known by 64 bits of hash: of a billion different ones, about one pair in 37 such corpora shares a count.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloutlens.llm.blocks import blocks_of, dids_of, rows_of, texts_of
from rolloutlens.llm.common import drop_files, from_planes, ngrams, own_shuffles_dropped, planes, real_id, word_hashes, written

#: What a step down costs (the fixed value of the method).
BACKOFF = 0.4
#: Entries of a hash partition, about.
PARTITION = 700_000
_SENT = "p int, block long, keys binary, counts binary"


def _words(row: dict) -> list[np.ndarray]:
    """Word hashes of each text of a block."""
    return [word_hashes(t.split()) for t in texts_of(row)]


def _stages(orders: int) -> list[tuple[int, ...]]:
    """The orders that are exchanged together: an n-gram of three words or more is only sent if both its parts of one word less occur in other documents, as it can't otherwise."""
    return [tuple(range(1, min(orders, 2) + 1)), *((n,) for n in range(3, orders + 1))]


def _slices_of(keys: np.ndarray, partitions: int) -> list[tuple[int, int, int]]:
    """(partition, first, end) of sorted keys; a partition is a range of them."""
    part = (keys >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
    return [(int(part[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class _Block:
    """A block's words, and by order how often the n-gram that ends at a word occurs in other documents."""

    def __init__(self, row: dict):
        self.words = _words(row)
        self.n = np.array([len(w) for w in self.words])
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        self.place = (np.arange(len(self.doc)) - np.repeat(np.cumsum(self.n) - self.n, self.n)).astype(np.int32)
        self.others: list[np.ndarray] = []

    def sent(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(where, n-grams): the words at which n-grams of the order end that are sent."""
        whole = np.flatnonzero(self.place >= order - 1)
        grams = np.concatenate([np.zeros(0, np.uint64), *(ngrams(w, order) for w in self.words)])
        if order < 3:
            return whole, grams
        seen = self.others[order - 2] > 0
        both = seen[whole] & seen[whole - 1]
        return whole[both], grams[both]

    def take(self, stage: tuple[int, ...], answers: dict[int, bytes], partitions: int) -> None:
        found = [self.sent(order) for order in stage]
        keys, at = np.unique(np.concatenate([g for _, g in found]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        for p, a, b in _slices_of(keys, partitions):
            sums[a:b] = from_planes(answers[p], 6)
        for where, of in zip([w for w, _ in found], np.split(at, np.cumsum([len(g) for _, g in found])[:-1]), strict=True):
            _, same, own = np.unique(self.doc[where].astype(np.int64) * (len(keys) + 1) + of, return_inverse=True, return_counts=True)
            left = np.zeros(len(self.doc), np.int64)
            left[where] = sums[of] - own[same]
            self.others.append(left)


def _answered(row: dict, totals: list[dict], stages: list[tuple[int, ...]], partitions: int) -> _Block:
    block = _Block(row)
    for k, stage in enumerate(stages):
        block.take(stage, {r["p"]: r["totals"] for r in totals if r["stage"] == k}, partitions)
    return block


def _pieces(block: _Block, name: int, stage: tuple[int, ...], partitions: int) -> pa.Table:
    keys, counts = np.unique(np.concatenate([block.sent(order)[1] for order in stage]), return_counts=True)
    rows = [(p, name, planes(np.diff(keys[a:b], prepend=np.uint64(0)), 8), planes(counts[a:b], 4)) for p, a, b in _slices_of(keys, partitions)]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["p", "block", "keys", "counts"])


def _totals(stage: int):
    def total(table: pa.Table) -> pa.Table:
        """For one hash partition: sum the counts of each n-gram and answer each block with the totals of what it sent, in its order."""
        keys = [np.cumsum(from_planes(x, 8)) for x in table["keys"].to_pylist()]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        values, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([from_planes(x, 4) for x in table["counts"].to_pylist()])
        sums = np.bincount(at, counts, len(values)).astype(np.int64)[at]
        return pa.table([table["block"], pa.array(np.full(len(keys), stage, np.int32)), table["p"], pa.array([planes(x, 6) for x in np.split(sums, cuts)], pa.binary())], ["block", "stage", "p", "totals"])

    return total


def exchanged(blocks: DataFrame, orders: int, partitions: int) -> list[DataFrame]:
    """(block, stage, p, totals), a table for each of ``_stages``: how often the n-grams that a block sent to a partition occur in the corpus, in its order."""
    stages, tables = _stages(orders), []

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield from _pieces(_Block(row), row["block"], stages[0], partitions).to_batches()

    def later(k: int):
        def count(block: pa.Table, totals: pa.Table) -> pa.Table:
            (row,) = block.to_pylist()
            return _pieces(_answered(row, totals.to_pylist(), stages[:k], partitions), row["block"], stages[k], partitions)

        return count

    def exchange(k: int) -> DataFrame:
        sent = blocks.groupBy("block").cogroup(reduce(DataFrame.unionAll, tables).groupBy("block")).applyInArrow(later(k), _SENT) if k else blocks.mapInArrow(first, _SENT)
        return written(sent.groupBy("p").applyInArrow(_totals(k), "block long, stage int, p int, totals binary"), "lm-totals", compression="zstd")

    with own_shuffles_dropped(blocks.sparkSession):
        for k in range(len(stages)):
            tables.append(exchange(k))
    return tables


def _block_scores(orders: int, partitions: int):
    def score(table: pa.Table, totals: pa.Table) -> pa.Table:
        (row,) = table.to_pylist()
        block = _answered(row, totals.to_pylist(), _stages(orders), partitions)
        doc, n, others = block.doc, block.n, block.others
        log = np.zeros(len(doc))
        used = np.zeros(len(doc), np.int8)
        history = np.minimum(block.place, orders - 1)  # words before that the model looks at
        for order in range(orders, 1, -1):
            where = np.flatnonzero((used == 0) & (others[order - 1] > 0))
            log[where] = np.log(others[order - 1][where] / others[order - 2][where - 1]) + (history[where] - (order - 1)) * math.log(BACKOFF)
            used[where] = order
        rest = np.flatnonzero(used == 0)
        log[rest] = np.log(np.maximum(others[0][rest], 1)) + history[rest] * math.log(BACKOFF)
        used[rest] = 1
        by_order = np.stack([np.bincount(doc[used == o], minlength=len(n)) for o in range(1, orders + 1)], axis=1)
        return pa.table([pa.array(dids_of(row)), pa.array(n.astype(np.int64)), pa.array(by_order.tolist(), pa.list_(pa.int64())), pa.array(np.bincount(doc, log, len(n)))], ["did", "n_words", "used", "log_sum"])

    return score


def lm_scores(docs: DataFrame, orders: int = 3) -> DataFrame:
    """(doc_id, n_words, used, score, mean_score) for each row.

    used counts the words by the order their score comes from; score sums natural logarithms of stupid-backoff scores S: count(n-gram) / count(history) if
    the n-gram occurs in other documents, else BACKOFF times S of one order less; at last count(word) / words of other documents, an unseen word counting once.
    The first words of a document start at the order that their place allows. Null and empty texts have no words and score 0 (mean null); a null doc_id
    stays null; repeated rows are documents of their own.
    """
    blocks = written(blocks_of(docs), "lm-blocks")
    size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()["size"]
    partitions = max(12, size // 5 // PARTITION)  # a word and its space are 6 to 7 bytes; unigrams and bigrams, of which a third repeat in a block
    totals = exchanged(blocks, orders, partitions)
    scored = blocks.groupBy("block").cogroup(reduce(DataFrame.unionAll, totals).groupBy("block")).applyInArrow(_block_scores(orders, partitions), "did long, n_words long, used array<long>, log_sum double")
    with own_shuffles_dropped(docs.sparkSession):
        scored = written(scored, "lm-scores")
    drop_files(docs.sparkSession, blocks, *totals)
    words = scored.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"))
    score = F.col("log_sum") - F.col("used")[0] * F.log(F.greatest(F.col("words") - F.col("n_words"), F.lit(1)))
    return scored.crossJoin(words).select(real_id().alias("doc_id"), "n_words", "used", score.alias("score"), F.try_divide(score, "n_words").alias("mean_score"))  # words is one row


def brute_force(texts: list[tuple[int, bytes]], orders: int = 3) -> dict[int, tuple[int, list[int], float]]:
    """doc_id -> (words, used, score) by plain counting, for tests."""
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    words = {d: t.split() for d, t in texts}
    own = {d: [Counter(grams(w, n)) for n in range(1, orders + 1)] for d, w in words.items()}
    total = [Counter() for _ in range(orders)]
    for counts in own.values():
        for n in range(orders):
            total[n].update(counts[n])
    everything, out = sum(map(len, words.values())), {}
    for d, w in words.items():
        left = lambda g: total[len(g) - 1][g] - own[d][len(g) - 1][g]  # noqa: B023, E731
        used, score = [0] * orders, 0.0
        for i in range(len(w)):
            top = min(i + 1, orders)
            for n in range(top, 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1 or left(gram) > 0:
                    below = left(gram[:-1]) if n > 1 else max(everything - len(w), 1)
                    score += math.log(max(left(gram), 1) / below) + (top - n) * math.log(BACKOFF)
                    used[n - 1] += 1
                    break
        out[d] = (len(w), used, score)
    return out
