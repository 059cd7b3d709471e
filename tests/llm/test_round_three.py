"""Clustering, fill-in-middle and fingerprints against brute force, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolloutlens.llm import centroids, fill_middle, fingerprints

DOCS = "doc_id long, text string, n long, form string, did long, h1 string, part int"  # all but the first two clash with inner names


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", 2, "h", 3) for i, t in rows], DOCS)


def _texts():
    rng = random.Random(3)
    words = [rng.choice("abcdefgh") + rng.choice(["the", "Über", "re", "漢字", "ou"]) + rng.choice(["", ",", ".", "!"]) for _ in range(300)]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" "] * 9 + ["\n"]) for _ in range(n))
    return [make(n) for n in (1, 2, 5, 40, 200, 900, 90)] + ["", None, "\n", "\n\n\n", " \t ", "no line end", "a<P>b\nc", "x<S>", "<M>", "<", "<S", "ends with <\n<", "é" * 5000, "x" * 40, "a b " * 70, "\r\n" * 3]


# --- clustering ------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, did long, v string, cluster int"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 7, "v", 1) for i, v in rows], VECTORS)


def _lloyd(rows, k, rounds, scale, seed, dims):
    kept = [(i, [math.floor(scale * x) if abs(x) < 1e300 else math.floor(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    points = [list(v) for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        points = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else p for c, p in enumerate(points)]
    placed = [(i, near(v)[1], min(near(v)[0], centroids.LARGEST)) for i, v in kept]
    return placed, points


def _odd_vectors():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(i % 5, 0.4, 6).tolist()) for i in range(300)]
    rows += [(300, rows[3][1]), (3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, None), (301, None), (302, []), (303, [1.0] * 5), (304, [1.0] * 7), (305, [1.0, None, 1, 1, 1, 1]), (306, [math.nan] * 6), (307, [1.0, 2, math.inf, 1, 1, 1])]
    return rows + [(308, [0.0] * 6), (309, [-0.0] * 6), (310, [1e-300, -1e-300, 0.5, -0.5, 1 / 64, -1 / 64])]


@pytest.mark.parametrize("more", [[], [(400, [1e9, -3e9, 5.0, 1e15, -1e15, 0.0]), (401, [1e9] * 6)], [(400, [1e300, -1e308, 1.0, 2.0, 3.0, 4.0]), (401, [1e30] * 6), (402, [-1.7e308] * 6)]])
def test_clusters_equal_plain_python(spark, more):
    rows = _odd_vectors() + more
    for k, rounds in ((16, 3), (3, 1), (5, 0), (2000, 2)):
        placed, points = centroids.cluster(_vectors(spark, rows).repartition(3), 6, k, rounds, 64, 1)
        want, want_points = _lloyd(rows, k, rounds, 64, 1, 6)
        assert points == want_points
        key = lambda r: tuple((x is not None, x or 0) for x in r)
        assert sorted(map(tuple, placed.collect()), key=key) == sorted(want, key=key)
        if k == 16:
            sums = Counter()
            for _, c, s in want:
                sums[c] += s
            for r in centroids.with_inertia(placed).collect():
                assert (r["cluster_inertia"], r["inertia"]) == (min(sums[r["cluster"]], centroids.LARGEST), min(sum(sums.values()), centroids.LARGEST))


def test_empty_clusters_keep_their_place_and_ties_go_to_the_smaller_number(spark):
    rows = [(i, [1.0, 1.0]) for i in range(20)]
    placed, points = centroids.cluster(_vectors(spark, rows), 2, 4, 3)
    assert points == [[64, 64]] * 4 and {r["cluster"] for r in placed.collect()} == {0}


def test_no_vectors(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        placed, points = centroids.cluster(_vectors(spark, rows), 2)
        assert points == [] and placed.count() == 0 and centroids.with_inertia(placed).count() == 0


def test_tables_hold_squared_differences():
    got = centroids.tables([[-3, 5], [7]], [[1, 2], [0, -4]])
    assert [t.tolist() for t in got] == [[[16, 9], [16, 25]], [[25, 121]]]
    assert centroids.tables([[10**30]], [[0]])[0][0, 0] == 10**60
    assert all(sum(x << 32 * k for k, x in enumerate(centroids.limbs(n))) == n for n in (0, 1, -1, 2**32, -(2**70) - 5, 10**50))


# --- fill-in-middle --------------------------------------------------------------------------------------------------

UNIT = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+", "word": r"[^\n\r \t\x0b\x0c]*[\n\r \t\x0b\x0c]|[^\n\r \t\x0b\x0c]+"}


def _cut(doc_id, text, unit, rate, spm, seed):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "rate", "spm", "seed"), [("line", 100, 50, 7), ("word", 60, 0, 1), ("sentence", 90, 100, 2)])
def test_fill_middle_equals_plain_python(spark, unit, rate, spm, seed):
    rows = [(i, t) for i, t in enumerate(_texts() * 3)] + [(None, "one\ntwo\nthree\n"), (None, None), (4, "again\nhere"), (4, "again\nhere")]
    got = fill_middle.fill_middle(_docs(spark, rows).repartition(2), unit, rate, spm, seed).withColumn("back", fill_middle.restored()).collect()
    want = [(*_cut(i, t, unit, rate, spm, seed), t or "") for i, t in rows]
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert fill_middle.fill_middle(_docs(spark, [])).count() == 0


def test_fill_middle_of_a_very_long_text(spark):
    text = "".join(f"line {i} é\n" for i in range(500_000))
    (got,) = fill_middle.fill_middle(_docs(spark, [(11, text)])).collect()
    assert tuple(got) == _cut(11, text, "line", 100, 50, 7)


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 8, n).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(values)
        for v in range(8):
            places = np.flatnonzero(values == v)
            assert matrix.rank(v, np.arange(n + 1)).tolist() == np.concatenate([[0], np.cumsum(values == v)]).tolist()
            assert matrix.select(v, np.arange(1, len(places) + 1)).tolist() == places.tolist()
        places = np.flatnonzero(np.isin(values, (0, 3, 6)))
        assert matrix.reach((0, 3, 6), np.arange(1, len(places) + 1)).tolist() == places.tolist()


def test_unknown_units_are_refused(spark):
    for bad in ({"unit": "page"}, {"rate": 101}, {"spm": -1}):
        with pytest.raises(ValueError, match="unit"):
            fill_middle.fill_middle(_docs(spark, []), **bad)


# --- fingerprints ----------------------------------------------------------------------------------------------------


def _terms(text):
    words = text.encode().split()
    return Counter(w for w in words if len(w) <= 32) + Counter(w[i : i + 8] for w in words if len(w) > 32 for i in range(len(w) - 7))


def _similarity(a, b):
    x, y = _terms(a), _terms(b)
    least = sum((x & y).values())
    return least / (sum(x.values()) + sum(y.values()) - least) if x or y else 1.0


def test_collisions_equal_generalised_jaccard():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    errors = []
    for share in (0.1, 0.5, 0.9):
        for _ in range(12):
            a = " ".join(rng.choices(words, k=150))
            b = " ".join(w if rng.random() < share else rng.choice(words) for w in a.split())
            sa, sb = fingerprints.signatures([a.encode(), b.encode()], 2048)
            errors.append((sa == sb).mean() - _similarity(a, b))
    assert max(map(abs, errors)) < 0.06 and abs(np.mean(errors)) < 0.006  # standard deviation 0.011 each


def test_a_draw_is_exponential_in_its_weight():
    rng = np.random.default_rng(2)
    names = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    for weight in (1, 3, 50):
        drawn = fingerprints.draws(names, np.full(len(names), math.log(weight)), 5) >> np.uint64(32)
        bits = drawn.astype(np.uint32)
        values = np.where(bits >> np.uint32(31), bits & np.uint32(0x7FFFFFFF), ~bits).view(np.float32)
        assert abs(np.exp(values.astype(np.float64)).mean() * weight - 1) < 0.03
        assert np.array_equal(np.argsort(drawn, kind="stable"), np.argsort(values, kind="stable"))


def test_edit_likeness_equals_plain_python(spark):
    rows = [(10 * i, t) for i, t in enumerate(_texts())] + [(None, "null id"), (30, "again thirty"), (30, "again thirty"), (-5, "first of all ids")]
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = fingerprints.edit_likeness(_docs(spark, rows)).collect()
            order = [(r["doc_id"], r["text"] or "") for r in _docs(spark, rows).withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.col("doc_id").asc_nulls_first(), "th", "text").collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        want = {}
        for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
            cut = len(a) // 4
            new = a[: len(a) - cut] + b[:cut]
            want.setdefault((i, len(a), hashlib.sha256(new.encode()).hexdigest()), []).append((a, new, b))
        assert len(got) == len(rows)
        for r in got:
            a, new, b = want[r["doc_id"], r["n_chars"], r["edited_sha256"]].pop()
            own, other, following = (fingerprints._named(fingerprints.signatures([t.encode()]), [t.encode()])[0] for t in (a, new, b))
            assert (r["fingerprint"], r["edited_fingerprint"]) == (own, other)
            assert r["near_edited"] == fingerprints.same(own, other) and r["near_next"] == fingerprints.same(own, following)
            assert abs(r["near_edited"] - _similarity(a, new)) < 0.25


def test_fingerprints_of_odd_tables(spark):
    rows = [(1, "some words here"), (2, "some words here"), (3, None), (4, ""), (5, " \n"), (None, "x"), (None, "x"), (6, "y" * 4_500_000)]
    got = {}
    for r in fingerprints.fingerprints(_docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r["fingerprint"])
    assert got[1] == got[2] and len(got[1][0]) == 256 and got[3] == got[4] == got[5] == [""] and len(got[None]) == 2
    assert fingerprints.fingerprints(_docs(spark, [])).count() == 0 and fingerprints.edit_likeness(_docs(spark, [])).count() == 0
    (one,) = fingerprints.edit_likeness(_docs(spark, [(1, "a b c d e f g h")])).collect()
    assert one["n_chars"] == 15 and one["edited_sha256"] == hashlib.sha256(b"a b c d e f a b").hexdigest() and one["near_next"] == 1.0


def test_likeness_as_an_expression(spark):
    texts = ["a b c d e f g", "a b c d x y z", "", "q"]
    names = fingerprints._named(fingerprints.signatures([t.encode() for t in texts]), [t.encode() for t in texts])
    pairs = [(a, b) for a in names for b in names]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fingerprints.likeness("a", "b").alias("s")).collect()
    assert all(r["s"] == fingerprints.same(r["a"], r["b"]) for r in got)
