"""Lloyd's algorithm on whole numbers, with distances from lookup tables.

Vectors are turned into whole numbers once and written in blocks: for each dimension the values that occur in the block, in order, and for each vector their places in that list.
In a round a task tabulates, for each dimension, occurring value and centroid, the squared difference; a block's distances are then gathers from these tables, added up over the dimensions.
Only sums leave a task: a row for each centroid, dimension and limb of 32 bits, so the shuffle has a size that the parameters bound, and Spark adds exact numbers of any size.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloutlens.llm.blocks import rows_of
from rolloutlens.llm.common import NULL_ID, drop_files, real_id, written

#: Numbers of a block; 64 components make blocks of 4096 vectors.
BLOCK_NUMBERS = 1 << 18
#: Distances and components beyond are told as this one.
LARGEST = (1 << 63) - 1
_BLOCK = "dids binary, codes binary, width int, spelled string"


def kept_vectors(vectors: DataFrame, dims: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(did, v) of the vectors with exactly ``dims`` components, none null or non-finite; v as doubles, a null id as NULL_ID."""
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    chosen = vectors.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("did"), v.alias("v"))
    return chosen.where((F.size("v") == dims) & F.coalesce(finite, F.lit(False)))


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly where the product is too large for a double."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else math.floor(x) * scale


def _blocks(kept: DataFrame, dims: int, scale: int) -> DataFrame:
    rows = max(1, BLOCK_NUMBERS // dims)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                if np.abs(x).max() * scale < 2.0**52:
                    values = np.floor(x * scale).astype(np.int64)
                else:
                    values = np.array([[whole(y, scale) for y in row] for row in x.tolist()], object)
                lists, codes = zip(*(np.unique(values[:, d], return_inverse=True) for d in range(dims)), strict=True)
                width = 1 if max(map(len, lists)) <= 256 else 2 if max(map(len, lists)) <= 65536 else 4
                packed = np.stack(codes).astype(f"<u{width}").tobytes()
                yield pa.RecordBatch.from_pylist([{"dids": part.column("did").to_numpy().tobytes(), "codes": packed, "width": width, "spelled": json.dumps([x.tolist() for x in lists])}], BLOCK_ARROW)

    return kept.mapInArrow(pack, _BLOCK)


BLOCK_ARROW = pa.schema([("dids", pa.binary()), ("codes", pa.binary()), ("width", pa.int32()), ("spelled", pa.string())])


def tables(lists: list[list[int]], centroids: list[list[int]]) -> list[np.ndarray]:
    """For each dimension the squared differences, by occurring value and centroid; in whole numbers of Python where 64 bits might not hold a distance."""
    largest = max((abs(x) for row in (*lists, *centroids) for x in row), default=0)
    kind = np.int64 if len(lists) * (2 * largest) ** 2 < 2**63 else object
    points = np.array(centroids, kind)
    return [(np.array(values, kind)[:, None] - points[None, :, d]) ** 2 for d, values in enumerate(lists)]


def nearest(row: dict, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """Of a block: for each vector its centroid (ties: the smaller number) and distance; the codes by dimension and the values that they stand for."""
    lists = json.loads(row["spelled"])
    codes = np.frombuffer(row["codes"], f"<u{row['width']}").reshape(len(lists), -1)
    total = 0
    for table, code in zip(tables(lists, centroids), codes, strict=True):
        total = total + table[code]
    best = np.argmin(total, axis=1)
    return best, total[np.arange(len(best)), best], codes, lists


def limbs(number: int) -> list[int]:
    """Parts of 32 bits, lowest first, all with the number's sign: their sums stand for the numbers' sum."""
    sign, number, out = (-1 if number < 0 else 1), abs(number), []
    while number:
        out.append(sign * (number & 0xFFFFFFFF))
        number >>= 32
    return out or [0]


def _moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floor of the mean of each one's vectors; one without vectors stays."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0] * len(centroids)
        sums = [[0] * len(centroids[0]) for _ in centroids]
        for row in rows_of(batches):
            best, _, codes, lists = nearest(row, centroids)
            for c in range(len(centroids)):
                counts[c] += int((best == c).sum())
            for d, values in enumerate(lists):
                # how often each occurring value was sent to each centroid
                times = np.bincount(best * len(values) + codes[d], minlength=len(centroids) * len(values)).reshape(len(centroids), -1)
                for c, row_ in enumerate(times):
                    at = np.flatnonzero(row_)
                    sums[c][d] += sum(map(int.__mul__, row_[at].tolist(), (values[i] for i in at.tolist())))
        out = [(c, -1, 0, n) for c, n in enumerate(counts) if n]
        out += [(c, d, k, x) for c, n in enumerate(counts) if n for d, s in enumerate(sums[c]) for k, x in enumerate(limbs(s))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["c", "d", "limb", "x"])

    # up to centroids x (dims x limbs + 1) rows, whatever the table's size
    found = blocks.mapInArrow(add, "c int, d int, limb int, x long").groupBy("c", "d", "limb").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    counts = {r["c"]: int(r["x"]) for r in found if r["d"] < 0}
    moved = [list(p) if c not in counts else [0] * len(p) for c, p in enumerate(centroids)]
    for r in found:
        if r["d"] >= 0:
            moved[r["c"]][r["d"]] += int(r["x"]) << 32 * r["limb"]
    return [[x // counts[c] for x in p] if c in counts else p for c, p in enumerate(moved)]


def cluster(vectors: DataFrame, dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each kept vector and the final centroids.

    Kept are vectors with exactly ``dims`` components, none null or non-finite; a component x counts as floor(scale * x). The first centroids are the k kept vectors with the smallest
    sha256 of ``seed:id`` (a null id as the empty string; equal ids: by components), or all if there are fewer. Each round assigns every vector to the nearest centroid (ties: the smaller
    number) and moves each centroid to the floor of its vectors' mean; after the rounds the vectors are assigned once more. Repeated rows count each; a distance over 2^63 - 1 is told as
    that; other columns are left aside. No kept vector: an empty table and no centroids.
    """
    kept = kept_vectors(vectors, dims, id_column, vector_column)
    spelled = F.concat(F.lit(f"{seed}:"), F.coalesce(F.nullif(F.col("did"), F.lit(NULL_ID)).cast("string"), F.lit("")))
    first = kept.orderBy(F.sha2(spelled, 256), "v").limit(k).select("v").collect()
    centroids = [[whole(x, scale) for x in r["v"]] for r in first]
    if not centroids:
        return kept.selectExpr("did as vec_id", "0 as cluster", "0L as distance").where("false"), []
    blocks = written(_blocks(kept, dims, scale), "vectors")
    for _ in range(rounds):
        centroids = _moved(blocks, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            best, distance, _, _ = nearest(row, centroids)
            told = distance if distance.dtype == np.int64 else np.array([min(x, LARGEST) for x in distance], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["dids"], np.int64)), pa.array(best, pa.int32()), pa.array(told, pa.int64())], ["did", "cluster", "distance"])

    placed = written(blocks.mapInArrow(assign, "did long, cluster int, distance long"), "clusters")
    drop_files(vectors.sparkSession, blocks)
    return placed.select(real_id().alias("vec_id"), "cluster", "distance"), centroids


def with_inertia(placed: DataFrame) -> DataFrame:
    """``placed`` (cluster, distance, ...) with cluster_inertia and inertia, the distances added up over the cluster and over all (a sum over 2^63 - 1 is told as that)."""
    told = lambda x: F.least(x, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid
    rows = [(r["cluster"], r["s"], sum(x["s"] for x in sums)) for r in sums]
    by_cluster = placed.sparkSession.createDataFrame(rows, "cluster int, s decimal(38,0), t decimal(38,0)")
    return placed.join(F.broadcast(by_cluster), "cluster").select(*placed.columns, told(F.col("s")).alias("cluster_inertia"), told(F.col("t")).alias("inertia"))
