"""The pool draw against plain Python, and its texts read back."""

import hashlib
import json
from itertools import combinations
from math import isqrt

from pyspark.sql import functions as F

from rolloutlens.functions.recompute import with_recomputed
from rolloutlens.operators import draws


def _h(*parts):
    return int(hashlib.md5(":".join(map(str, (42, *parts))).encode()).hexdigest()[:8], 16)


def _divisors(n):
    return [d for d in range(1, n + 1) if n % d == 0]


def _first_with(most=60_000):
    """The smallest number with so many divisors, by sieve."""
    counts = [0] * most
    for d in range(1, most):
        for n in range(d, most, d):
            counts[n] += 1
    first = {}
    for n in range(1, most):
        first.setdefault(counts[n], n)
    return first


SMALLEST = _first_with()


def _clause(n, k):
    return sum(d % 2 == 1 if k["cond"] == "odd" else d > k["gt_thresholds"] if k["cond"] == "gt" else d < k["lt_thresholds"] for d in _divisors(n))


def _gold(concept, k, x0):
    """(gold, fed value), None for a draw that the guard refuses."""
    triples = lambda n: sum(1 for a, b, c in combinations(range(n + 1), 3) if a + b + c == n)
    if concept == "modular_exponent":
        return (g, None) if (g := k["a"] ** k["e"] % k["m"]) >= 5 else None
    if concept == "chain_constrained_divisor_count__modular_exponent":
        e = _clause(k["num_pool"], k)
        return (g, e) if 4 <= e <= 20 and (g := k["a"] ** e % k["m"]) >= 5 else None
    if concept == "chain_log_laws__ordered_triple_constraint":
        s = k["N"] + k["e3"]
        return (g, k["N"]) if max(4, s - 20) <= min(20, s - 4) and (g := triples(k["N"])) >= 5 else None
    if concept == "chain_prime_power_divisors__constrained_divisor_count":
        n = SMALLEST[k["D"]]
        return (g, n) if 60 <= n <= 2520 and (g := _clause(n, k)) >= 3 else None
    if concept == "complex_modulus_power":
        n = k["cand_range"][0] + x0 % (k["cand_range"][1] - k["cand_range"][0])
        pairs = [(a, isqrt(n - a * a)) for a in range(1, isqrt(n) + 1) if isqrt(n - a * a) ** 2 == n - a * a and isqrt(n - a * a) >= a]
        return (sum(map(sum, pairs)), None) if k["rep_cap"][0] <= len(pairs) <= k["rep_cap"][1] else None
    if concept == "constrained_divisor_count":
        return (g, None) if (g := _clause(k["num_pool"], k)) >= 3 else None
    if concept == "constrained_subset_count":
        return (g, None) if (g := sum(sum(c) % k["mod"] == x0 % k["mod"] for c in combinations(range(1, k["n"] + 1), 3))) >= 5 else None
    if concept == "divisor_sum_filter":
        g = sum(d for d in _divisors(k["n"]) if (d % 2 == 1) == (k["cond"] == "odd"))
        return (g, None) if sum(k["n"] % p == 0 for p in (3, 5, 7, 11, 13, 17, 19, 23)) >= 3 and g >= 15 else None
    if concept == "inclusion_exclusion_3set":
        return (g, None) if (g := sum(any(x % d == 0 for d in k["divisor_triples"]) for x in range(1, k["U"] + 1))) >= 10 else None
    if concept == "log_laws":
        return k["e1"] + k["e2"] - k["e3"], None
    if concept == "ordered_triple_constraint":
        return (g, None) if (g := triples(k["N"])) >= 5 else None
    if concept == "prime_power_divisors":
        return SMALLEST[k["D"]], None
    tri = [n * (n + 1) // 2 for n in range(1, 200)]
    return (g, None) if (g := sum(x < k["lim"] and x % k["k"] == 0 for x in tri)) >= 3 else None


def test_draws_equal_plain_python_and_texts_read_back(spark):
    concepts = sorted(draws.RECIPES)
    ids = [(i, concepts[i % len(concepts)]) for i in range(260)] + [(1, "unheard of"), (None, None)]
    table = spark.createDataFrame(ids, "id long, concept string")
    got = {(r["id"], r["turn"]): r for r in draws.pool_draw(table, draws.spec_table(spark), 3, 12).collect()}
    want = {}
    for i, concept in ids[:260]:
        turn = 0
        for attempt in range(12):
            k = {}
            for c, p, kind, v in draws.SPECS:
                if c == concept:
                    h = _h(concept, p, i, attempt)
                    k[p] = v[0] + h % (v[1] - v[0] + 1) if kind == "randint" else v[h % len(v)] if kind == "choice" else v
            found = _gold(concept, k, _h(concept, "x0", i, attempt))
            if found and turn < 3:
                turn += 1
                used = {p for p in k if not p.endswith("_thresholds") or p == f"{k.get('cond')}_thresholds"}
                want[i, turn] = (concept, str(found[0]), found[1], {p: k[p] for p in used})
    assert set(got) == set(want) and len({r["concept"] for r in got.values()}) == 13
    for key, (concept, answer, fed, knobs) in want.items():
        r = got[key]
        assert (r["concept"], r["answer"], r["fed_value"]) == (concept, answer, fed)
        assert {p: json.loads(v) if v[0] in "[0123456789" else v for p, v in r["knobs"].items()} == knobs
    rows = spark.createDataFrame([(r["concept"], r["problem"], r["answer"]) for r in got.values()], "concept string, problem string, answer string")
    for r in with_recomputed(rows).collect():
        assert r["exact"] == r["answer"], (r["concept"], r["problem"], r["answer"], r["exact"], r["reason"])


def test_draws_are_dealt_out_and_repeated_ids_share_their_turns(spark):
    ids = [(i, "log_laws") for i in range(64)] + [(3, "log_laws"), (None, "log_laws"), (None, "log_laws"), (5, None)]
    table = spark.createDataFrame(ids, "id long, concept string").coalesce(1)
    specs = draws.spec_table(spark)
    drawn = draws.pool_draw(table, specs)
    assert drawn.select(F.spark_partition_id()).distinct().count() > 2
    got = {}
    for r in drawn.collect():
        got.setdefault(r["id"], []).append((r["turn"], r["problem"]))
    assert {i: len(x) for i, x in got.items()} == {i: 3 for i in (*range(64), None)}
    once = {r["turn"]: r["problem"] for r in draws.pool_draw(table.where("id = 3").limit(1), specs).collect()}
    assert sorted(got[3]) == [(1, once[1]), (2, once[1]), (3, once[2])]
    assert len({p for _, p in got[None]}) == 2


def test_a_draw_ends_with_the_last_that_is_wanted(spark):
    table = spark.createDataFrame([(i, "prime_power_divisors") for i in range(40)], "id long, concept string")
    specs = draws.spec_table(spark)
    few = {(r["id"], r["turn"], r["problem"]) for r in draws.pool_draw(table, specs, 3, 3).collect()}
    assert {(r["id"], r["turn"], r["problem"]) for r in draws.pool_draw(table, specs, 3, 1_000_000).collect()} == few and len(few) == 120
