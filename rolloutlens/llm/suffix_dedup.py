"""Removal of byte strings that occur earlier, with a logarithmic family of sparse suffix arrays.

Documents come in batches. A batch's suffix array holds the suffixes at anchors: of the 32-byte strings inside each 100-byte window
the one with the least hash is its anchor, so equal windows have equal anchors at equal places, and about one position in 35 is one. An array is in the order
of the first 32 bytes of its suffixes, which it carries, and is cut into hash partitions. A new array is merged with all levels of the family in one scan: neighbours with
a common prefix of 32 bytes or more are shared anchors. Then levels of equal rank merge, so a corpus of n batches has at most log2(n) + 1 levels. A level keeps one
entry for each anchor: the others were reported when they came in. Each batch scans all levels, so many small batches cost more than a few large ones.

The windows at shared anchors are compared by a 64-bit hash and then byte by byte, in order of document and start; all but the first of equal windows are repeats.
Inside a block, only one of equal anchors or runs of windows is passed on, so a very common passage costs each block one row. An anchor that HOT or more suffixes
share is dealt window by window, by 128 bits of hash, so that no task takes all its surroundings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlens.llm.blocks import SCHEMA, blocks_of, dids_of, rows_of, texts_of
from rolloutlens.llm.common import drop_files, from_planes, mix, new_path, planes, real_id, release_shuffles, written

#: Bytes of a string that counts as repeated, and of the anchor inside it.
LENGTH, ANCHOR = 100, 32
#: Suffixes in a hash partition, and window starts of a text worked on at a time.
PARTITION, SEGMENT = 250_000, 4 << 20
#: A suffix stands for some 35 windows, so their hash partitions are smaller by this factor.
WINDOWS_EACH = 8
#: Suffixes that share an anchor, at least, for its windows to be dealt one by one.
HOT = 2_000
_BASE, _BASE2, _BASE3 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
_PLACE = np.uint64((1 << 28) - 1)


def rolling(data: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hashes of all substrings of ``length`` bytes, by doubling."""
    power, have, out = np.uint64(base), 1, mix(data.astype(np.uint64) + np.uint64(1))
    single, powers = out, {1: base}
    for bit in bin(length)[3:]:
        out = out[: len(out) - have] * power + out[have:]
        power, have = np.uint64(int(power) ** 2 & (1 << 64) - 1), have * 2
        if bit == "1":
            out = out[: len(out) - 1] * np.uint64(powers[1]) + single[have : have + len(out) - 1]
            power, have = np.uint64(int(power) * base & (1 << 64) - 1), have + 1
    return out


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, places, first window start, window starts) of a text's runs of windows with one anchor, in order."""
    parts = []
    for a in range(0, max(len(raw) - LENGTH + 1, 0), SEGMENT):
        data = np.frombuffer(raw, np.uint8, min(SEGMENT + LENGTH - 1, len(raw) - a), a)
        h = mix(rolling(data, ANCHOR, _BASE))
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        have, span = 1, LENGTH - ANCHOR + 1
        while have * 2 <= span:
            low, have = np.minimum(low[:-have], low[have:]), have * 2
        if have < span:
            low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
        place = (low & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        parts.append((h[place[first]], place[first] + a, first + a, np.diff(np.append(first, len(place)))))
    if not parts:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _partition_runs(values: np.ndarray, partitions: int) -> Iterator[tuple[int, np.ndarray]]:
    part = ((values >> np.uint64(20)) % np.uint64(partitions)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
        yield int(part[run[0]]), run


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _unzip(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data else b""


def _in_suffix_order(suffixes: np.ndarray) -> np.ndarray:
    """Positions of rows of ANCHOR bytes in lexicographic order, equal ones as they come."""
    columns = suffixes.view(">u8").astype(np.uint64)
    return np.lexsort([columns[:, k] for k in range(ANCHOR // 8 - 1, -1, -1)])


_ARRAYS = "kind string, rank int, p int, block long, suffixes binary, counts binary, blocks binary, ords binary"
_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)


def _packed(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    return pa.table([pa.array(x, t) for x, t in zip(columns, _TYPES, strict=True)], ["kind", "rank", "p", "block", "suffixes", "counts", "blocks", "ords"])


def _starts(suffixes: np.ndarray) -> np.ndarray:
    """Where the common prefix with the suffix before is shorter than ANCHOR."""
    return np.flatnonzero(np.append(True, (suffixes[1:] != suffixes[:-1]).any(axis=1))) if len(suffixes) else np.zeros(0, np.int64)


def suffix_arrays(blocks: DataFrame, partitions: int) -> DataFrame:
    """A block's suffix array in hash partitions: kind "new", ANCHOR bytes of each suffix in order, how many equal it, and its number among the block's anchors.

    Of equal suffixes in a block one is in the array; all of them are also reported as "shared".
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            prints, bodies = [np.zeros(0, np.uint64)], [np.zeros((0, ANCHOR), np.uint8)]
            for text in texts_of(row):
                fp, place, _, _ = anchors(text)
                if len(fp):
                    prints.append(fp)
                    bodies.append(np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), ANCHOR)[place])
            fp, body, rows = np.concatenate(prints), np.concatenate(bodies), []
            for p, at in _partition_runs(fp, partitions):
                at = at[_in_suffix_order(np.ascontiguousarray(body[at]))]
                in_order = body[at]
                starts = _starts(in_order)
                size = np.diff(np.append(starts, len(at)))
                rows.append(("new", 0, p, row["block"], _zip(in_order[starts].tobytes()), planes(size, 4), b"", planes(at[starts], 4)))
                if (size > 1).any():
                    rows.append(("shared", 0, p, row["block"], b"", b"", b"", at[np.repeat(size > 1, size)].astype("<i4").tobytes()))
            yield from _packed(rows).to_batches()

    return blocks.mapInArrow(build, _ARRAYS)


def _scan_and_merge(merged: tuple[int, ...], hot: int):
    """For one hash partition: merge-scan the new suffix arrays against all levels, report shared anchors and those that ``hot`` suffixes or more share, and merge the levels of ``merged`` ranks into one."""

    def scan(table: pa.Table) -> pa.Table:
        rows, held = [], []
        for r in table.to_pylist():
            if r["kind"] == "shared":
                rows.append(tuple(r.values()))
                continue
            new = r["kind"] == "new"
            unzip = (lambda x: x) if new else _unzip
            suffixes = np.frombuffer(_unzip(r["suffixes"]), np.uint8).reshape(-1, ANCHOR)
            counts, ords = (from_planes(unzip(r[c]), 4).astype(np.int64) for c in ("counts", "ords"))
            blocks = np.full(len(suffixes), r["block"]) if new else np.frombuffer(_unzip(r["blocks"]), np.int64)
            held.append((suffixes, counts, blocks, ords, np.full(len(suffixes), new), np.full(len(suffixes), new or r["rank"] in merged)))
        if not held:
            return _packed(rows)
        suffixes, counts, blocks, ords, new, kept = map(np.concatenate, zip(*held, strict=True))
        del held
        order = _in_suffix_order(suffixes)
        suffixes, counts, blocks, ords, new, kept = suffixes[order], counts[order], blocks[order], ords[order], new[order], kept[order]
        starts, p = _starts(suffixes), table["p"][0].as_py()
        size = np.diff(np.append(starts, len(order)))
        hit = np.repeat((size > 1) & np.logical_or.reduceat(new, starts), size)
        by_block = np.argsort(blocks[hit], kind="stable")
        for run in np.split(by_block, np.flatnonzero(np.diff(blocks[hit][by_block])) + 1) if len(by_block) else []:
            rows.append(("shared", 0, p, int(blocks[hit][run[0]]), b"", b"", b"", ords[hit][run].astype("<i4").tobytes()))
        heavy = np.add.reduceat(counts, starts) >= hot
        if heavy.any():
            rows.append(("heavy", 0, p, 0, suffixes[starts[heavy]].tobytes(), b"", b"", b""))
        suffixes, counts, blocks, ords = suffixes[kept], counts[kept], blocks[kept], ords[kept]
        one = _starts(suffixes)
        total = np.add.reduceat(counts, one) if len(one) else counts
        rows.append(("level", len(merged), p, 0, _zip(suffixes[one].tobytes()), _zip(planes(total, 4)), _zip(blocks[one].tobytes()), _zip(planes(ords[one], 4))))
        return _packed(rows)

    return scan


class SuffixFamily:
    """Texts, suffix arrays by rank and reports of shared anchors, as tables in the shared folder.

    ``add`` takes the next batch, ``ranges`` gives what repeats among all batches so far. ``state`` can be kept, and a family opened from it in another session
    scans new batches against the levels there are. ``close`` deletes all tables.
    """

    def __init__(self, spark: SparkSession, partitions: int, hot: int = HOT, state: dict | None = None):
        self.spark = spark
        self.state = state or {"partitions": partitions, "hot": hot, "levels": {}, "texts": [], "reports": []}

    def _table(self, schema: str, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def _arrays(self, texts: str, merged: tuple[int, ...], path: str) -> None:
        rows = suffix_arrays(self._table(SCHEMA, texts), self.state["partitions"])
        for level in self.state["levels"].values():
            rows = rows.unionAll(self._table(_ARRAYS, level).where("kind = 'level'"))
        rows.groupBy("p").applyInArrow(_scan_and_merge(merged, self.state["hot"]), _ARRAYS).write.parquet(path)

    def add(self, docs: DataFrame) -> None:
        spark, state, merged = self.spark, self.state, []
        while str(len(merged)) in state["levels"]:
            merged.append(len(merged))
        texts, path, reports = (new_path(spark, f"suffix-{x}") for x in ("texts", "arrays", "reports"))
        blocks_of(docs, len(state["texts"])).write.parquet(texts)
        self._arrays(texts, tuple(merged), path)
        self._table(_ARRAYS, path).where("kind <> 'level'").select("kind", "block", "suffixes", "ords").write.parquet(reports)
        for rank in merged:
            drop_files(spark, state["levels"].pop(str(rank)))
        state["levels"][str(len(merged))] = path
        state["texts"].append(texts)
        state["reports"].append(reports)
        release_shuffles(spark)

    def texts(self) -> DataFrame:
        return self._table(SCHEMA, *self.state["texts"])

    def shared(self) -> DataFrame:
        """(block, shared): for each of a block's anchors, up to the last shared one, a bit."""

        def bits(table: pa.Table) -> pa.Table:
            ords = np.concatenate([np.frombuffer(x, "<i4") for x in table["ords"].to_pylist()])
            found = np.zeros(int(ords.max()) + 1, bool)
            found[ords] = True
            return pa.table([table["block"].slice(0, 1), pa.array([_zip(np.packbits(found).tobytes())], pa.binary())], ["block", "shared"])

        found = self._table("kind string, block long, ords binary", *self.state["reports"]).where("kind = 'shared'")
        return found.select("block", "ords").groupBy("block").applyInArrow(bits, "block long, shared binary")

    def heavy(self) -> np.ndarray:
        """Fingerprints of the anchors that the family's hot number of suffixes or more share: at most all suffixes / hot, 65,536 as ``suffix_dedup`` sets it."""
        found = self._table("kind string, suffixes binary", *self.state["reports"]).where("kind = 'heavy'").select("suffixes").toArrow()
        raw = b"".join(found["suffixes"].to_pylist())
        return np.unique([mix(rolling(np.frombuffer(raw, np.uint8, ANCHOR, a), ANCHOR, _BASE))[0] for a in range(0, len(raw), ANCHOR)] or np.zeros(0, np.uint64))

    def drop_levels(self) -> None:
        for rank in list(self.state["levels"]):
            drop_files(self.spark, self.state["levels"].pop(rank))

    def close(self) -> None:
        self.drop_levels()
        drop_files(self.spark, *self.state["texts"], *self.state["reports"])


_WINDOWS = "kind string, q int, block long, runs binary, body binary"


def _window_pieces(blocks: DataFrame, partitions: int, heavy: np.ndarray) -> DataFrame:
    """Windows of ``blocks`` (with shared) at shared anchors: kind "windows" packed with their bytes, "hot" window by window with a second hash, "gone" for runs that the block has met earlier."""

    shared = blocks.sparkSession.sparkContext.broadcast(heavy)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield from one(row)

    def one(row: dict) -> Iterator[pa.RecordBatch]:
        wanted = np.flatnonzero(np.unpackbits(np.frombuffer(_unzip(row["shared"]), np.uint8)))
        held, before = [], 0
        for doc, (did, text) in enumerate(zip(dids_of(row).tolist(), texts_of(row), strict=True)):
            fp, _, first, count = anchors(text)
            at = wanted[np.searchsorted(wanted, before) : np.searchsorted(wanted, before + len(fp))] - before
            if len(at):
                th = xxhash.xxh64_intdigest(text) >> 1
                heat = np.isin(fp[at], shared.value).tolist()
                held += [(did, th, a, f, n, doc, text[a : a + n + LENGTH - 1], x) for f, a, n, x in zip(fp[at].tolist(), first[at].tolist(), count[at].tolist(), heat, strict=True)]
            before += len(fp)
        held.sort(key=lambda r: r[:3])
        seen: dict[tuple[int, bytes], tuple] = {}
        pieces: dict[tuple[str, int], list[tuple]] = {}
        met: dict[tuple[int, int], tuple] = {}
        for did, th, a, f, n, doc, body, heat in held:
            kind = "windows" if seen.setdefault((f, body), (did, th, a)) == (did, th, a) else "gone"
            if kind == "windows" and heat:
                data = np.frombuffer(body, np.uint8)
                keys = mix(rolling(data, LENGTH, _BASE2) ^ np.uint64(f))
                for k, (x, y) in enumerate(zip(keys.tolist(), mix(rolling(data, LENGTH, _BASE3)).tolist(), strict=True)):
                    first = met.setdefault((x, y), (did, th, a + k)) == (did, th, a + k)
                    pieces.setdefault(("hot" if first else "gone", (x >> 20) % partitions), []).append((x, did, th, doc, a + k, 1, y.to_bytes(8, "little")))
            else:
                pieces.setdefault((kind, (f >> 20) % partitions), []).append((f, did, th, doc, a, n, body))
        out = []
        for (kind, q), rows in pieces.items():
            prints, *cols, body = zip(*rows, strict=True)
            runs = np.array(prints, np.uint64).tobytes() + np.array(cols, np.int64).tobytes()
            out.append((kind, q, row["block"], _zip(runs), b"" if kind == "gone" else _zip(b"".join(body))))
        if out:
            types = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["kind", "q", "block", "runs", "body"])

    return blocks.mapInArrow(cut, _WINDOWS)


def _equal_windows(body: np.ndarray, at: np.ndarray, run: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a window (at its place in body, part of a run) equals one before it: by key, then by its bytes."""
    by_key = np.argsort(key, kind="stable")
    same = key[by_key[1:]] == key[by_key[:-1]]
    model = np.full(len(at), -1)
    model[by_key[1:][same]] = at[by_key[:-1][same]]
    repeat = model >= 0
    follows = np.append(False, repeat[1:] & repeat[:-1] & (run[1:] == run[:-1]) & (model[1:] == model[:-1] + 1))
    right = np.ones(len(at), bool)
    last = np.flatnonzero(follows)
    right[last] = body[at[last] + LENGTH - 1] == body[model[last] + LENGTH - 1]  # its other bytes are in the window before
    heads, span = np.flatnonzero(repeat & ~follows), np.arange(LENGTH)
    for a in range(0, len(heads), 10_000):
        some = heads[a : a + 10_000]
        right[some] = (body[at[some, None] + span] == body[model[some, None] + span]).all(axis=1)
    if not right.all():  # different windows share a key: tell them apart by their bytes
        wrong = np.isin(key, key[~right])
        met: set[bytes] = set()
        for k in np.flatnonzero(wrong).tolist():
            window = body[at[k] : at[k] + LENGTH].tobytes()
            repeat[k] = window in met
            met.add(window)
    return repeat


def _by_block(block: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """(block, ranges): the columns (doc, start, end) of each block, packed."""
    order = np.argsort(block, kind="stable")
    rows = [(int(block[run[0]]), b"".join(planes(c[run], 5) for c in columns)) for run in (np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else [])]
    names, packed = zip(*rows, strict=True) if rows else ([], [])
    return pa.table([pa.array(names, pa.int64()), pa.array(packed, pa.binary())], ["block", "ranges"])


def _repeats(table: pa.Table) -> pa.Table:
    """(block, ranges): byte ranges that repeated windows cover, for one hash partition."""
    out, live, hot = [np.zeros((4, 0), np.int64)], [], []
    for r in table.to_pylist():
        cols = list(np.frombuffer(_unzip(r["runs"]), np.int64).reshape(6, -1))  # fp, did, th, doc, first, count
        block = np.full(len(cols[0]), r["block"])
        if r["kind"] == "gone":
            out.append(np.array([block, cols[3], cols[4], cols[4] + cols[5] + LENGTH - 1]))
        elif r["kind"] == "hot":
            hot.append([*cols, block, np.frombuffer(_unzip(r["body"]), np.int64)])
        else:
            live.append(([*cols, block], _unzip(r["body"])))
    if hot:
        key, did, th, doc, first, _, block, key2 = map(np.concatenate, zip(*hot, strict=True))
        order = np.lexsort((first, th, did, key2, key))
        key, did, th, first, key2 = key[order], did[order], th[order], first[order], key2[order]
        same = (key[1:] == key[:-1]) & (key2[1:] == key2[:-1])
        once = (did[1:] == did[:-1]) & (th[1:] == th[:-1]) & (first[1:] == first[:-1])  # rows equal in doc_id and text are one document
        head = np.maximum.accumulate(np.append(0, np.where(~same | ~once, np.arange(1, len(key)), 0)))
        repeat = np.append(False, same)[head]
        out.append(np.array([block[order], doc[order], first, first + LENGTH])[:, repeat])
    if live:
        fp, did, th, doc, first, count, block = (np.concatenate([c[j] for c, _ in live]) for j in range(7))
        body = np.frombuffer(b"".join(b for _, b in live), np.uint8)
        lengths = count + LENGTH - 1
        order = np.lexsort((first, th, did))
        again = np.append(False, (np.diff(did[order]) == 0) & (np.diff(th[order]) == 0) & (np.diff(first[order]) == 0))
        alike = np.cumsum(~again) - 1  # rows equal in doc_id and text are one document
        chosen = order[~again]
        at = (np.cumsum(lengths) - lengths)[chosen]
        run = np.repeat(np.arange(len(chosen)), count[chosen])
        within = np.arange(len(run)) - np.repeat(np.cumsum(count[chosen]) - count[chosen], count[chosen])
        places = at[run] + within
        key = mix(rolling(body, LENGTH, _BASE2)[places] ^ fp[chosen][run].view(np.uint64))
        repeat = _equal_windows(body, places, run, key)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.where(repeat, run + 1, 0), [0]])))
        begin, end = edge[:-1][repeat[edge[:-1]]], edge[1:][repeat[edge[1:] - 1]]
        owners = np.argsort(alike, kind="stable")  # all rows of a document, for each that was worked on
        for shift in range(int(np.bincount(alike).max())):
            each = np.searchsorted(alike[owners], run[begin]) + shift
            fits = (each < len(owners)) & (alike[owners][np.minimum(each, len(owners) - 1)] == run[begin])
            of = order[owners[each[fits]]]
            b, e = begin[fits], end[fits]
            out.append(np.array([block[of], doc[of], first[of] + within[b], first[of] + within[e - 1] + LENGTH]))
    block, *columns = np.concatenate(out, axis=1)
    return _by_block(block, columns)


def spans(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_DIGEST = "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    for row in rows_of(batches):
        parts = [np.array([from_planes(x[k * len(x) // 3 : (k + 1) * len(x) // 3], 5) for k in range(3)]).astype(np.int64) for x in row["parts"] or ()]
        doc, start, end = np.concatenate([np.zeros((3, 0), np.int64), *parts], axis=1)
        order = np.argsort(doc, kind="stable")
        doc, found = doc[order], list(zip(start[order].tolist(), end[order].tolist(), strict=True))
        rows = []
        for k, (did, text) in enumerate(zip(dids_of(row).tolist(), texts_of(row), strict=True)):
            gone = spans(found[np.searchsorted(doc, k) : np.searchsorted(doc, k + 1)])
            edges = [0, *(x for s in gone for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((did, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in gone]))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["did", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_ranges(family: SuffixFamily) -> DataFrame:
    """(block, parts): packed byte ranges that repeated windows cover, as a written table."""
    shared = written(family.shared(), "suffix-shared")
    windows = _window_pieces(family.texts().join(shared.hint("merge"), "block"), WINDOWS_EACH * family.state["partitions"], family.heavy())
    ranges = windows.groupBy("q").applyInArrow(_repeats, "block long, ranges binary")
    found = written(ranges.groupBy("block").agg(F.collect_list("ranges").alias("parts")), "suffix-ranges")
    drop_files(family.spark, shared)
    return found


def digests(family: SuffixFamily) -> DataFrame:
    """Rows of _DIGEST for all documents of a family."""
    found = repeated_ranges(family)
    release_shuffles(family.spark)
    return family.texts().join(found.hint("merge"), "block", "left").mapInArrow(_digests, _DIGEST)


def suffix_dedup(docs: DataFrame, batches: int = 3) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row: bytes covered by a 100-byte string that also starts earlier.

    Texts are UTF-8 bytes, null ones empty. Earlier is a smaller doc_id (null first), then a smaller hash of the text, then a smaller start; rows equal
    in doc_id and text are one document. Texts under 100 bytes lose nothing. ``docs`` are added to a new family in ``batches`` by doc_id.
    """
    cuts = [f"percentile_approx(doc_id, {k / batches})" for k in range(1, batches)]
    facts = docs.selectExpr("cast(doc_id as long) as doc_id", "octet_length(text) as size").selectExpr("coalesce(sum(size), 0) as size", f"cast(array({', '.join(cuts)}) as array<long>) as cuts").first()
    family = SuffixFamily(docs.sparkSession, max(12, facts["size"] // (35 * PARTITION)), max(HOT, facts["size"] // (35 << 16)))
    edges = [None, *sorted({c for c in facts["cuts"] or () if c is not None}), None]
    for a, b in zip(edges, edges[1:], strict=False):
        part = docs.where(F.col("doc_id") > a) if a is not None else docs
        family.add(part.where(F.coalesce(F.col("doc_id") <= b, F.lit(True))) if b is not None else part)
    family.drop_levels()
    done = digests(family)
    return done.select(real_id().alias("doc_id"), *done.columns[1:])


def brute_force(texts: list[tuple[int, bytes]]) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> digest by a set of all windows, for tests."""
    seen: set[bytes] = set()
    out = {}
    for did, raw in sorted(texts):
        found = []
        for a in range(len(raw) - LENGTH + 1):
            window = raw[a : a + LENGTH]
            if window in seen:
                found.append((a, a + LENGTH))
            seen.add(window)
        gone = spans(found)
        kept = bytearray()
        at = 0
        for a, b in gone:
            kept += raw[at:a]
            at = b
        kept += raw[at:]
        out[did] = (len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
    return out
