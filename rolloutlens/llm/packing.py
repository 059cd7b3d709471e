"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Only the length histogram (at most ``capacity`` rows, whatever the corpus) goes to the driver. There the configuration
linear program - how often to use each multiset of lengths that fits a sequence - is solved by multiplicative weights:
a length that is covered loses weight, and the next configurations are the best ones at these weights, found by a
knapsack dynamic program. The solution is rounded down, what it leaves is solved and rounded again, and the rest is packed best-fit decreasing, on counts of
equal lengths. The weights also give a lower bound of the number of sequences.
Spark gives each piece its rank among pieces of its length, and the plan turns length and rank into a place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolloutlens.llm.common import id_and_text, real_id, slices, written
from rolloutlens.llm.tokens import encoder

PIECES = "did long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, kind: str, end_id: int, capacity: int) -> DataFrame:
    """Rows of PIECES: ids of each text and ``end_id``, cut from the end into pieces of ``capacity``; nth counts a length's pieces in a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer_path, kind), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4")
        for batch in slices(batches):
            rows = []
            for did, ids in zip(batch.column("did").to_pylist(), enc.ids(batch.column("text").to_pylist()), strict=True):
                data = memoryview(np.concatenate([ids, end])).cast("B")
                first = (len(data) // 4 - 1) % capacity + 1
                bounds = [0, *range(first, len(data) // 4 + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append((did, k, a, b - a, zlib.crc32(data[4 * a : 4 * b]), part, seen[b - a]))
                    seen[b - a] += 1
            names = ["did", "piece", "start", "length", "ids_crc32", "part", "nth"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return id_and_text(docs).mapInArrow(cut, PIECES)


def best_configurations(price: np.ndarray, capacity: int) -> tuple[np.ndarray, list[Counter]]:
    """For each row of ``price`` (by length, -inf for lengths that aren't there) the multiset of lengths within capacity of the highest total price, and that price.

    Unbounded knapsack for all rows at once. ``back`` holds the values in falling order of capacity, so that each step reads one slice.
    """
    lengths, rows = np.flatnonzero(np.isfinite(price[0])), np.arange(len(price))
    least, most = int(lengths[0]), int(lengths[-1])
    back, choice = np.zeros((len(price), capacity + 1)), np.zeros((len(price), capacity + 1), np.int32)
    for c in range(least, capacity + 1):
        end = min(c, most) + 1
        got = back[:, capacity - c + least : capacity - c + end] + price[:, least:end]
        at = got.argmax(axis=1)
        top, before = got[rows, at], back[:, capacity - c + 1]
        choice[:, c] = np.where(top >= before, at + least, 0)
        back[:, capacity - c] = np.maximum(top, before)
    out = []
    for row in choice:
        found, c = Counter(), capacity
        while c > 0:
            found[int(row[c])] += 1
            c -= int(row[c]) or 1
        del found[0]
        out.append(found)
    return back[:, 0], out


def solve_configurations(demand: dict[int, int], capacity: int, rounds: int, width: int = 8, rate: float = 3.0) -> tuple[list[tuple[tuple[tuple[int, int], ...], float]], float]:
    """(configuration, number of times) of an approximate solution of the configuration linear program, and a lower bound of its value.

    A length's weight falls with the share of its demand that is covered. Each round prices ``width`` variations of the weights and adds the best configuration of
    each as often as covers half of its scarcest length's demand. Weights are prices of the dual program: divided by what the best configuration
    costs at them, they bound the number of sequences from below. The bound is the best of those of the rounds, of their mean, and of the size.
    """
    sizes = np.array(sorted(demand))
    need = np.array([demand[s] for s in sizes], float)
    by_size, covered, total = sizes / capacity, np.zeros(len(sizes)), np.zeros(len(sizes))
    noise, price, times, bound = np.random.default_rng(1), np.full((width, capacity + 1), -np.inf), Counter(), float(need @ sizes) / capacity
    for _ in range(rounds):
        weight = by_size * np.exp(-rate * (covered - covered.min()))
        total += weight / (weight @ need)
        price[:, sizes] = weight * np.exp(0.1 * noise.standard_normal((width, len(sizes))))
        price[0, sizes], price[-1, sizes] = weight, total
        worth, found = best_configurations(price, capacity)
        bound = max(bound, float(weight @ need) / worth[0], float(total @ need) / worth[-1])
        for f in found:
            at, count = np.searchsorted(sizes, list(f)), np.array(list(f.values()), float)
            step = float(np.min(need[at] / count)) / 2
            times[tuple(sorted(f.items()))] += step
            covered[at] += count * step / need[at]
        if covered.min() >= 1:
            break
    return list(times.items()), bound


def _best_fit(demand: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on counts: bins of one content are handled together."""
    bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    done = []

    def put(content: tuple, n: int, room: int) -> None:
        (bins.setdefault(room, []) if room else done).append((content, n))

    for size in sorted(demand, reverse=True):
        left = demand[size]
        while left and (fits := [r for r in bins if r >= size]):
            room = min(fits)
            content, n = bins[room].pop()
            if not bins[room]:
                del bins[room]
            each = min(room // size, left)
            used = min(n, left // each)
            if used < n:
                put(content, n - used, room)
            put((*content, (size, each)), used, room - each * size)
            left -= each * used
        each = capacity // size
        if left >= each:
            put(((size, each),), left // each, capacity - each * size)
        if left % each:
            put(((size, left % each),), 1, capacity - left % each * size)
    return done + [x for some in bins.values() for x in some]


Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def _rounded(histogram: dict[int, int], capacity: int, rounds: int, passes: int, whole: bool) -> tuple[Plan, float]:
    """(content, copies) and the lower bound: the linear program's configurations (only ones without a gap if ``whole``), rounded down, again for what is left, then best fit."""
    left, out, bound = Counter(histogram), [], 0.0
    for k in range(passes):
        if not left:
            break
        found, least = solve_configurations(left, capacity, rounds)
        bound = bound or least
        before = len(out)
        for content, times in sorted(found, key=lambda x: (-sum(s * n for s, n in x[0]), -x[1])):
            copies = min(int(times), *(left[s] // n for s, n in content))
            if copies and (not whole or sum(s * n for s, n in content) == capacity):
                out.append((content, copies))
                for s, n in content:
                    left[s] -= n * copies
        left = Counter({s: n for s, n in left.items() if n})
        if len(out) == before:
            break
    return out + _best_fit(left, capacity), bound


def plan_with_bound(histogram: dict[int, int], capacity: int, rounds: int = 100, passes: int = 3) -> tuple[Plan, int]:
    """(content, copies) over all sequences, content being (length, count) pairs, and how many sequences any plan needs at least.

    Lengths that combine without gaps are tried first; if that takes more than a sequence for each length above the bound, configurations with gaps
    are used too, and the shortest of these plans and of best fit alone counts. A plan's size depends on the lengths, not on the number of pieces.
    """
    rest = Counter(histogram)
    full = [(((capacity, 1),), rest.pop(capacity))] if rest.get(capacity) else []
    plans, bound = [], 0.0
    for whole in (True, False):
        plan, least = _rounded(rest, capacity, rounds, passes, whole)
        plans.append(plan)
        bound = max(bound, least)
        if sum(n for _, n in plan) <= bound + len(rest):
            break
    plans.append(_best_fit(rest, capacity))
    return full + min(plans, key=lambda p: sum(n for _, n in p)), sum(n for _, n in full) + int(np.ceil(bound - 1e-6))


def plan_sequences(histogram: dict[int, int], capacity: int, rounds: int = 100, passes: int = 3) -> Plan:
    return plan_with_bound(histogram, capacity, rounds, passes)[0]


def place_pieces(pieces: DataFrame, capacity: int, rounds: int = 100) -> DataFrame:
    """Rows of PIECES with sequence_id and offset. ``pieces`` must be a written table: it's read three times."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, base, ranks = [], 0, Counter()
    for content, copies in plan_sequences(histogram, capacity, rounds):
        offset = 0
        for size, each in content:
            runs.append((size, ranks[size], base, each, offset))
            ranks[size] += each * copies
            offset += size * each
        base += copies
    shape = np.array(sorted(runs), np.int64).reshape(-1, 5)
    keys = (shape[:, 0] << 44) + shape[:, 1]
    plan = pieces.sparkSession.sparkContext.broadcast((keys, shape))  # bounded by the number of lengths and rounds

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shape = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = shape[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            nth = rank - run[:, 1]
            sequence, offset = run[:, 2] + nth // run[:, 3], run[:, 4] + nth % run[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    counts = pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).select("did", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "did long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, kind: str = "spaced", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; a null doc_id stays null; repeated rows are packed each; an empty table gives no rows.
    """
    pieces = written(cut_pieces(docs, tokenizer_path, kind, end_id, capacity), "pieces")
    placed = place_pieces(pieces, capacity)
    return placed.select(real_id().alias("doc_id"), *placed.columns[1:])
