"""Exact n-gram Jaccard join as T-occurrence search with DivideSkip, spread over Spark.

A text's set of n distinct shingles shares at least T = ceil(percent * n / 100) with any text it links with. All sets are put in one order,
rarest shingles first. DivideSkip sets the T - t longest inverted lists of a set aside, t = 1 + n // MEET_EACH; its other, short lists are those of its
first n - T + t shingles. Two linked texts meet in t short lists or more, and in so many that the lists set aside can make up the rest: with r = T - t of each,
their overlap is at most meetings + the larger r. So meetings are counted pair by pair over the short lists, pairs with too few are dropped, and
what the long lists add is found by binary search in the sorted set, which gives the exact overlap.

Equal sets become one node, so copies cost nothing more. Links are looked for in rounds. In the first, a node meets only the smallest, the largest and a
random owner of each of some short lists, and is held against the most similar of those; this joins families of near copies with one probe a node. In the second, lists
that still mix components name four nodes each, and a node is held against the most similar of them outside its component. Both rounds cost rows in
proportion to the lists, however large a family is. In the third, all pairs of nodes from different components are counted as above; pairs inside a component
need no test. So no link between components is missed.

Meetings are sifted by parity sketches first: each shingle flips one of SKETCH_BITS bits, so the bits in which two sketches differ are never
more than the shingles in which the sets do. A pair whose sketches differ in more bits than a link allows can't link.
Nothing but names, sizes and postings is written; the sets of the nodes to be probed are made from their texts again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloutlens.llm.common import as_bytes, drop_files, from_planes, id_and_text, planes, real_id, release_shuffles, shingle_set, slices, written
from rolloutlens.llm.components import components

#: Shingles in one hash partition. Shingles in COMMON_AT texts or more are ordered by how many; CELLS bytes hold that order at any input size.
PARTITION, COMMON_AT, CELLS = 2_000_000, 4, 1 << 22
#: Shingles of a set for each further meeting; postings of the very common shingles that share a hash partition.
MEET_EACH, SPLIT = 64, 100_000
#: Short lists of a node that the first round looks at, about; bits of a node's parity sketch, in whole longs; nodes that one is held against in the second round.
FIRST_LISTS, SKETCH_BITS, NEAREST = 16, 512, 2
_LOW = np.uint64(0xFFFFFFFF)


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(shingles.tobytes()), "little", signed=True)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits as longs: how often, odd or even, a shingle falls on each bit."""
    odd = np.bincount((shingles % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_aside(n: int, percent: int) -> int:
    """How many of the longest lists of a set of n shingles aren't merged."""
    return -(-percent * n // 100) - (1 + n // MEET_EACH)


def _aside(n: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * n / 100) - (1 + F.floor(n / MEET_EACH))


def _by_partition(values: np.ndarray, by: np.ndarray, partitions: int, salt: int | np.ndarray = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of 64-bit ``values`` by their upper half, and salt, modulo the number of partitions: (partition, positions in ascending order of ``by``)."""
    part = (((values >> np.uint64(32)) + np.uint64(salt)) % np.uint64(partitions)).astype(np.int64)
    order = np.lexsort((by, part))
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for run in np.split(order, cuts) if len(order) else []:
        yield int(part[run[0]]), run


def _ascending(values: np.ndarray, width: int = 8) -> bytes:
    return planes(np.diff(values, prepend=np.uint64(0)), width)


def _batch(rows: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*rows, strict=True))], names)


def signatures(docs: DataFrame) -> DataFrame:
    """(did, th, n, node, sketch): the text's hash and size, name and sketch of its set; the name of equal sets is equal."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x) for x in as_bytes(batch.column("text"))]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), *columns], ["did", "th", "n", "node", "sketch"])

    return id_and_text(docs).withColumn("th", F.xxhash64("text")).mapInArrow(sign, "did long, th long, n long, node long, sketch array<long>")


def common_shingles(docs: DataFrame, partitions: int) -> np.ndarray:
    """By cell, a shingle modulo CELLS, eight times the binary logarithm of how many texts hold its most common shingle, or 0 if fewer than COMMON_AT do.

    All texts are counted. Shingles travel as 32 bits inside a hash partition, so those that share them are counted together; that and shared cells only move a shingle in the order.
    """

    def part_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                values = np.concatenate(held)
                held.clear()
                values.sort()
                starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
                counts = np.diff(np.append(starts, len(values)))
                values = values[starts]
                low = values & _LOW
                yield from _batch([(p, _ascending(low[at], 4), planes(counts[at], 4)) for p, at in _by_partition(values, low, partitions)], ["p", "low", "count"])

        for batch in slices(batches):
            held += [shingle_set(x) for x in as_bytes(batch.column("text"))]
            if sum(map(len, held)) > 2 * PARTITION:
                yield from flush()
        yield from flush()

    def common(table: pa.Table) -> pa.Table:
        values = np.concatenate([np.cumsum(from_planes(x, 4)) for x in table["low"].to_pylist()])
        counts = np.concatenate([from_planes(x, 4) for x in table["count"].to_pylist()]).astype(np.int64)
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        total = np.add.reduceat(counts, starts)
        keep = total >= COMMON_AT
        return pa.table([pa.array((values[starts][keep] % np.uint64(CELLS)).astype(np.int32)), pa.array(total[keep])], ["cell", "n"])

    pieces = id_and_text(docs).mapInArrow(part_counts, "p int, low binary, count binary")
    found = pieces.groupBy("p").applyInArrow(common, "cell int, n long").groupBy("cell").agg(F.max("n").alias("n")).toArrow()  # CELLS rows at most
    classes = np.zeros(CELLS, np.uint8)
    classes[found["cell"].to_numpy()] = np.minimum(255, 8 * np.log2(found["n"].to_numpy()))
    return classes


class Order:
    """Rarest first: by the class of a shingle's cell, then by hash."""

    def __init__(self, classes: np.ndarray):
        self.classes = classes

    def of(self, shingles: np.ndarray) -> np.ndarray:
        return self.classes[((shingles & _LOW) % np.uint64(CELLS)).astype(np.int64)]

    def prefix(self, shingles: np.ndarray, length: int) -> np.ndarray:
        return shingles[np.argsort(self.of(shingles), kind="stable")[:length]]


def short_lists(docs: DataFrame, order: Order, partitions: int, percent: int) -> DataFrame:
    """(shingle, node, n) of all short inverted lists with two nodes or more. The list of a very common shingle is dealt over several partitions by node."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # CELLS bytes

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = shared.value
        held: list[tuple[int, int, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                values = np.concatenate([x for _, _, x in held])
                lengths = [len(x) for _, _, x in held]
                nodes, sizes = (np.repeat(np.array(x, np.int64), lengths) for x in list(zip(*held, strict=True))[:2])
                ways = np.maximum(1, np.exp2(ordered.of(values) / 8) // SPLIT).astype(np.uint64)
                rows = [(p, _ascending(values[at]), nodes[at].tobytes(), planes(sizes[at], 4)) for p, at in _by_partition(values, values, partitions, nodes.view(np.uint64) % ways)]
                yield from _batch(rows, ["p", "shingle", "node", "n"])
                held.clear()

        seen: set[int] = set()
        for batch in slices(batches):
            for text in as_bytes(batch.column("text")):
                s = shingle_set(text)
                if len(s) and (node := _node(s)) not in seen:
                    seen.add(node)
                    held.append((node, len(s), ordered.prefix(s, len(s) - set_aside(len(s), percent))))
            if sum(len(x) for _, _, x in held) > PARTITION:
                yield from flush()
                seen.clear()
        yield from flush()

    def lists(table: pa.Table) -> pa.Table:
        s = np.concatenate([np.cumsum(from_planes(x, 8)) for x in table["shingle"].to_pylist()])
        node = np.concatenate([np.frombuffer(x, np.int64) for x in table["node"].to_pylist()])
        n = np.concatenate([from_planes(x, 4) for x in table["n"].to_pylist()]).astype(np.int32)
        at = np.lexsort((node, s))
        s, node, n = s[at], node[at], n[at]
        new = np.append(True, (s[1:] != s[:-1]) | (node[1:] != node[:-1]))  # copies in other tasks
        s, node, n = s[new], node[new], n[new]
        starts = np.append(True, s[1:] != s[:-1])
        keep = ~(starts & np.append(starts[1:], True)) | (shared.value.of(s) >= 8 * np.log2(2 * SPLIT))  # a split list is kept in all its parts
        return pa.table([pa.array(s[keep].view(np.int64)), pa.array(node[keep]), pa.array(n[keep])], ["shingle", "node", "n"])

    pieces = id_and_text(docs).mapInArrow(post, "p int, shingle binary, node binary, n binary")
    return pieces.groupBy("p").applyInArrow(lists, "shingle long, node long, n int")


def _probed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: the overlap is counted by binary search of one set in the other. Each a's set is sent once for each pair, each b's once."""
    spark = docs.sparkSession
    pairs = written(pairs, "pairs")
    ends = [written(pairs.select(F.col(c).alias("node")).distinct().join(nodes.select("node", "did"), "node"), "ends") for c in "ab"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = {n: s for n, s in zip(batch.column("node").to_pylist(), map(shingle_set, as_bytes(batch.column("text"))), strict=True) if _node(s) == n}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())], ["node", "shingles"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                short, long = (x, y) if len(x) < len(y) else (y, x)
                common = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = (id_and_text(docs).join(e, "did").mapInArrow(sets, "node long, shingles binary").select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c, e in zip("ab", ends, strict=True))
    links = written(pairs.join(a, "a").join(b, "b").mapInArrow(probe, "a long, b long").distinct(), "links")
    drop_files(spark, pairs, *ends)
    del a, b
    release_shuffles(spark)
    return links


def _need(percent: int) -> Column:
    """The overlap that a link of sizes n and m needs."""
    return F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / (100 + percent))


def _near_sizes(percent: int) -> Column:
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def _differ() -> Column:
    """Bits in which the two sketches of a meeting differ."""
    return reduce(add, [F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("other_sketch", F.lit(k)))) for k in range(SKETCH_BITS // 64)])


def _may_link(percent: int) -> Column:
    """What a meeting must pass: sizes, and sketches as near as a link needs."""
    return _near_sizes(percent) & (_differ() <= F.col("n") + F.col("m") - 2 * _need(percent))


def _mixed(lists: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of lists that hold nodes of different components, with component and sketch; of lists with the same nodes, as the shingles of a shared passage have, one with their number as weight."""
    rows = lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    holders = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"holders{k}") for k in range(2)]
    found = rows.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("length"), F.first("weight").alias("weight"), *holders).where("x <> y")
    kept = written(found.groupBy("length", "holders0", "holders1").agg(F.min("shingle").alias("shingle"), F.sum("weight").alias("weight")).select("shingle", "weight"), "mixed-lists")
    done = written(rows.drop("weight").join(kept, "shingle").join(nodes.select("node", "sketch"), "node"), "mixed")
    drop_files(lists.sparkSession, kept)
    return done


_OTHERS = {"node": "b", "n": "m", "component": "other", "sketch": "other_sketch"}


def _best_owners(lists: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): for each node the most similar, by sketch, of three: of the smallest, the largest and an arbitrary but fixed node of its lists, the ones that it meets most often."""
    some = lists.where(F.pmod("shingle", F.lit(64)) * (F.col("n") - _aside(F.col("n"), percent)) < 64 * FIRST_LISTS)
    entry = F.struct("n", "node")
    owners = some.groupBy("shingle").agg(F.min(entry).alias("low"), F.max(entry).alias("high"), F.min_by(entry, F.xxhash64("node")).alias("any"))
    met = some.join(owners, "shingle").select(
        F.col("node").alias("a"), "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("o")) for k, c in enumerate(("low", "high", "any"))])).alias("e")
    ).select("a", "n", "e.k", F.col("e.o.node").alias("b"), F.col("e.o.n").alias("m"))
    hits = met.where((F.col("a") != F.col("b")) & _near_sizes(percent)).groupBy("a", "k", "b", "n", "m").agg(F.count("*").alias("hits"))
    best = hits.groupBy("a", "k").agg(F.max_by(F.struct("b", "n", "m"), F.struct("hits", "b")).alias("e")).select("a", "e.*").distinct()
    both = best.join(nodes.select(F.col("node").alias("a"), "sketch"), "a").join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("other_sketch")), "b")
    return both.where(_may_link(percent)).groupBy("a").agg(F.min_by("b", F.struct(_differ(), "b")).alias("b"))


def _nearest_owners(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): for each node the NEAREST most similar, by sketch, of four nodes that each of its lists names, outside its component.

    A list names the nodes with the smallest and the largest of two hashes of shingle and node, so different lists name different ones.
    """
    entry = F.struct(*_OTHERS)
    named = [pick(entry, F.xxhash64("shingle", "node", F.lit(k))) for k in range(2) for pick in (F.min_by, F.max_by)]
    owners = mixed.groupBy("shingle").agg(F.array_distinct(F.array(*named)).alias("named")).select("shingle", F.explode("named").alias("o"))
    met = mixed.withColumnRenamed("node", "a").join(owners.select("shingle", *[F.col(f"o.{c}").alias(to) for c, to in _OTHERS.items()]), "shingle")
    telling = F.col("n") + F.col("m") - 2 * _need(percent) < 0.4 * SKETCH_BITS  # sketches of larger sets differ in half their bits, whatever they hold
    near = met.where((F.col("component") != F.col("other")) & telling & _may_link(percent)).select("a", "b", _differ().alias("d")).distinct()
    turn = Window.partitionBy("a").orderBy("d", "b")
    near = near.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= NEAREST)
    return near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _cross_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes from different components that meet in as many short lists as a link needs."""
    right = mixed.select("shingle", *[F.col(c).alias(to) for c, to in _OTHERS.items()])
    met = mixed.withColumnRenamed("node", "a").join(right, "shingle").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("other")) & _may_link(percent))
    counted = met.groupBy("a", "b", "n", "m").agg(F.sum("weight").alias("meetings"))
    least = F.greatest(F.lit(1), _need(percent) - F.greatest(_aside(F.col("n"), percent), _aside(F.col("m"), percent)))
    return counted.where(F.col("meetings") >= least).select("a", "b")


def linked(docs: DataFrame, percent: int = 80, with_group: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: texts link when 100 * intersection >= percent * union of their five-word shingle sets.

    A text of fewer than five words has one shingle; without words, or null, it has none and is alone. component_id is the smallest doc_id of all
    that links lead to; repeated rows come out each; a null doc_id counts for no component's smallest unless it's alone. ``with_group`` adds component, which is
    the same for all rows of a group whatever their ids, and th, xxhash64 of the text.
    """
    spark = docs.sparkSession
    signs = written(signatures(docs), "signs")
    total = signs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    partitions = max(12, -(-total // PARTITION))
    order = Order(common_shingles(docs, partitions))
    release_shuffles(spark)
    lists = written(short_lists(docs, order, partitions, percent), "lists")
    release_shuffles(spark)
    nodes = written(signs.join(lists.select("node").distinct(), "node").groupBy("node").agg(F.min("did").alias("did"), F.first("sketch").alias("sketch")), "nodes")
    links = _probed(docs, nodes, _best_owners(lists, nodes, percent), percent)
    labels = components(links)
    drop_files(spark, links)
    left = lists.withColumn("weight", F.lit(1).cast("long"))
    for candidates in (_nearest_owners, _cross_pairs):
        mixed = _mixed(left, labels, nodes)
        more = _probed(docs, nodes, candidates(mixed, percent), percent)
        known, labels = labels, components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        drop_files(spark, more, known, left)
        left = mixed.select("shingle", "node", "n", "weight")  # lists of one component stay so
    drop_files(spark, nodes, left)
    named = signs.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.where("n > 0").groupBy("component").agg(F.min(real_id()).alias("component_id"))
    joined = named.join(smallest, "component", "left")
    return joined.select(real_id().alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(real_id()).alias("component_id"), *(["component", "th"] if with_group else []))


def brute_force(texts: dict[int, bytes], percent: int = 80) -> dict[int, int]:
    """component_id by holding all texts against each other, for tests."""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(d: int) -> int:
        while parent[d] != d:
            d = parent[d]
        return d

    holders = defaultdict(list)
    for d, s in sorted(sets.items()):
        common = defaultdict(int)
        for x in s.tolist():
            for e in holders[x]:
                common[e] += 1
            holders[x].append(d)
        for e, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[e]) - c):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: root(d) for d in sets}
