"""Recomputed golds that need long numbers, fractions, factors or guards; texts that would have ended a job; the native and the exact form against each other."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from rolloutlens.functions import exact, numbers, recompute


def _run(spark, rows):
    table = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(rows)], "row_id long, concept string, problem string")
    return {r["row_id"]: (r["recomputed"], r["exact"], r["reason"]) for r in recompute.with_recomputed(table).collect()}


def _told(n):
    return (n, str(n), None) if -(2**63) <= n < 2**63 else (None, str(n), "overflow")


def _levels(x, depth):
    v = Fraction(x)
    for _ in range(depth - 1):
        v = x + 1 / v
    return v.numerator + v.denominator


LONG = 12345678901234567890123
CASES = [
    ("continued_fraction", "Reduce the 40-level continued fraction built from 9.", _told(_levels(9, 40))),
    ("continued_fraction", "Reduce the 3-level continued fraction built from 0.", (None, None, "domain")),
    ("custom_binary_op", "x#y = x+y+xy: 123456, 234567, 345678, 456789", _told(123457 * 234568 * 345679 * 456790 - 1)),
    ("custom_binary_op", f"x#y = x+y+xy: {LONG} and -3", _told((LONG + 1) * -2 - 1)),
    ("custom_binary_op", "only 5", (None, None, "domain")),
    ("modular_exponent", "3 to the 1000000000000 modulo 1000000007", _told(pow(3, 10**12, 10**9 + 7))),
    ("modular_exponent", f"{LONG} to the {LONG} divided by {LONG + 2}", _told(pow(LONG, LONG, LONG + 2))),
    ("modular_exponent", "5 to the 3 modulo 0", (None, None, "domain")),
    ("modular_exponent", "5 to the -1 modulo 7", _told(3)),
    ("modular_exponent", "5 to the 0 modulo 1", _told(0)),
    ("constrained_divisor_count", "How many divisors of 963761198400 are even?", _told(5760)),
    ("constrained_divisor_count", f"How many divisors of 963761198400 are greater than {LONG}?", _told(0)),
    ("constrained_divisor_count", f"How many divisors of 963761198400 are less than {LONG}?", _told(6720)),
    ("constrained_divisor_count", "How many divisors of 1000000016000000063 are odd?", _told(4)),  # 1000000007 x 1000000009
    ("constrained_divisor_count", "How many divisors of 999999999989 are odd?", _told(2)),
    ("constrained_divisor_count", "How many divisors of 0 are odd?", (None, None, "domain")),
    ("constrained_divisor_count", "How many divisors of 12?", (None, None, "domain")),
    ("divisor_sum_filter", "Add up the odd divisors of 999999999989.", _told(999999999990)),
    ("divisor_sum_filter", "Add up the even divisors of 1.", _told(0)),
    ("divisor_sum_filter", "Add up the even divisors of -6.", (None, None, "domain")),
    ("perfect_square_divisible", "squares below 1000000000000000000 that 12 divides", _told(999999999 // 6)),
    ("perfect_square_divisible", "squares below 100 that 0 divides", (None, None, "domain")),
    ("multi_constraint_square", "squares below 1000000000000 that 7 divides and end in 4", _told(sum((7 * j) ** 2 % 10 == 4 for j in range(1, 999999 // 7 + 1)))),
    ("multi_constraint_square", "squares below 100 that 0 divides and end in 4", (None, None, "domain")),
    ("triangular_filter_count", "triangular numbers below 1000000000000 divisible by 30", _told(sum(1 for k in range(1, 1414214) if k * (k + 1) // 2 < 10**12 and k * (k + 1) % 60 == 0))),
    ("triangular_filter_count", "triangular numbers below 10 divisible by 0", (None, None, "domain")),
    ("arith_term_filter", "first 1000000000 terms, first term 3, difference 4, multiples of 7", _told(142857143)),
    ("arith_term_filter", "first 40 terms, first term 3, difference 4, multiples of 0", (None, None, "domain")),
    ("arith_term_filter", "first 4 terms of the sequence 9, 5, ... divisible by 3", _told(sum((9 - 4 * i) % 3 == 0 for i in range(4)))),
    ("lattice_points_circle", "x^2+y^2 <= 1000000000", _told(3141592409)),
    ("lattice_points_circle", "x^2+y^2 <= 10^2", _told(317)),
    ("lattice_points_circle", f"x^2+y^2 <= {LONG}", (None, None, "too_large")),
    ("ordered_triple_constraint", f"a+b+c = {LONG}", _told((LONG * LONG + 6) // 12)),
    ("ordered_triple_constraint", "a+b+c = 7", _told(sum(1 for a in range(8) for b in range(a + 1, 8) for c in range(b + 1, 8) if a + b + c == 7))),
    ("alternating_cubes", f"-1^3 + 2^3 ... {LONG}", _told((LONG // 2) ** 2 * (4 * (LONG // 2) + 3))),
    ("complex_eq_solcount", f"z^{LONG} = conj(z)", _told(LONG + 2)),
    ("roots_of_unity_sum", "z^12200160415121876738 = 1 and z^7540113804746346429 = 1", _told(math.gcd(12200160415121876738, 7540113804746346429))),
    ("inclusion_exclusion_3set", "1 to 1000000000000000000, divisible by 2, 3 or 5", _told(sum(s * (10**18 // x) for s, x in ((1, 2), (1, 3), (1, 5), (-1, 6), (-1, 10), (-1, 15), (1, 30))))),
    ("inclusion_exclusion_3set", "1 to 100, divisible by 0, 3 or 5", (None, None, "domain")),
    ("telescoping_mn", "1/(k(k+40)) for k = 1 to 900", None),
    ("constrained_digit_count", "between 1 and 1000000000000 with digit sum of 5", _told(math.comb(16, 11))),
    ("count_pythagorean", "hypotenuse of at most 1000000", _told(1980642)),
    ("count_pythagorean", "hypotenuse of at most 100000", _told(161436)),
    ("count_pythagorean", "hypotenuse of at most 4", _told(0)),
    ("count_pythagorean", "hypotenuse of at most 20000000", None),
    ("complement_prob_mn", "a 3-sided die, better than 1/3", _told(2)),
    ("complement_prob_mn", "a 1000000-sided die, better than 1/2", _told(693147)),
    ("complement_prob_mn", "a 6-sided die, better than 1/0", (None, None, "domain")),
    ("complement_prob_mn", "a 6-sided die, better than 7/5", (None, None, "domain")),
    ("complex_modulus_power", "0<a<=b, a^2+b^2 = 1000000000000000000000000", None),
    ("complex_modulus_power", "0<a<=b, |a+bi| squared is 8450", _told(sum(a + b for a in range(1, 92) for b in range(a, 92) if a * a + b * b == 8450))),
    ("prime_power_divisors", "smallest with exactly 17 positive divisors", _told(65536)),
    ("prime_power_divisors", "smallest with exactly 19 positive divisors", _told(262144)),
    ("prime_power_divisors", "smallest with exactly 1 positive divisors", _told(1)),
    ("prime_power_divisors", "smallest with exactly 101 positive divisors", _told(2**100)),
    ("prime_power_divisors", "smallest with exactly 0 positive divisors", (None, None, "domain")),
    ("prime_power_divisors", f"smallest with exactly {LONG} positive divisors", (None, None, "too_large")),
    ("box_diagonal_sq", "edges with exactly 17 divisors", _told(2**32 + 3**32 + 5**32)),
    ("box_diagonal_sq", "edges with exactly 8 divisors", _told(24**2 + 30**2 + 40**2)),
    ("box_diagonal_sq", "edges with exactly 1 divisor", (None, None, "domain")),
    ("lcm_gcd_system", "With 6 it has 999999000000 and with 35 it has 35", _told(999999000000)),
    ("lcm_gcd_system", "With 6 it has 999999000000 and with 35 it has 1", (None, None, "domain")),
    ("lcm_gcd_system", "With 0 it has 12 and with 5 it has 1", (None, None, "domain")),
    ("poly_remainder", "999999999999x^3 + 1x^2 + 1x + 1 = 7999999999999", None),
    ("polynomial_sign_intervals", "multiplicities [1, , 2]", (None, None, "domain")),
    ("polynomial_sign_intervals", f"multiplicities [1, {LONG}]", _told(2)),
    ("algebraic_system_2eq", "99999999x+1y+1z=100000001; 1x+2y+1z=4; 1x+1y+3z=5", _told(3)),
    ("algebraic_system_2eq", "1x+1y+1z=3; 1x+1y+1z=3; 1x+1y+3z=5", (None, None, "domain")),
    ("algebraic_system_2eq", "1x+1y+1z=3; 1x+1y+1z=3", (None, None, "unread")),
    ("constrained_subset_count", "How many 100-element subsets of {1, ..., 200} have remainder 0 when divided by 1?", _told(math.comb(200, 100))),
    ("constrained_subset_count", "How many 3-element subsets of {1, ..., 9} have remainder 0 when divided by 0?", (None, None, "domain")),
    ("equalization_fraction", "first 2 are full and the last is 1/0 full", (None, None, "domain")),
    ("equalization_fraction", "first 2 are full and the last is 3/3 full", _told(1)),
    ("log_laws", f"log_2({2**90}) - log_2(2^80)", _told(10)),
    ("log_laws", "log_1(1)", (None, None, "domain")),
    ("log_laws", "log_5(25 + 0)", (None, None, "domain")),
    ("chain_log_laws__ordered_triple_constraint", "sum log_3(3^200 · 3^4 / 9)", _told((202 * 202 + 6) // 12)),
    ("chain_prime_power_divisors__constrained_divisor_count", "exactly 36 positive divisors; how many are odd?", _told(12)),
    ("chain_prime_power_divisors__constrained_divisor_count", "exactly 61 positive divisors; how many are greater than 5?", _told(58)),
    ("chain_prime_power_divisors__constrained_divisor_count", "exactly 71 positive divisors; how many are odd?", (None, None, "too_large")),
    ("chain_constrained_divisor_count__modular_exponent", "e: divisors of 963761198400 that are less than 9999999999999. 2^e mod 1000000007?", _told(pow(2, 6720, 10**9 + 7))),
    ("chain_constrained_divisor_count__modular_exponent", "e: divisors of 12 that are odd. 2^e mod 0?", (None, None, "domain")),
    ("nothing known", "5 6 7", (None, None, "unknown_concept")),
    (None, "5", (None, None, "unknown_concept")),
    ("log_laws", None, (None, None, "unread")),
    ("count_pythagorean", "", (None, None, "unread")),
]


def test_long_numbers_zero_divisors_and_odd_texts(spark):
    got = _run(spark, [(c, t) for c, t, _ in CASES])
    wanted = {i: want for i, (_, _, want) in enumerate(CASES) if want}
    assert {i: got[i] for i in wanted} == wanted
    by_text = {t: got[i] for i, (_, t, _) in enumerate(CASES)}
    total = sum(Fraction(1, k * (k + 40)) for k in range(1, 901))
    assert by_text["1/(k(k+40)) for k = 1 to 900"] == _told(total.numerator + total.denominator)
    assert by_text["hypotenuse of at most 20000000"][0] > 1980642 * 20
    assert all((r[0] is None) == (r[2] is not None) for r in got.values())


def test_counts_of_triangles_by_table(spark):
    for limit, want in ((10, 2), (100, 52), (1000, 881), (10_000, 12471)):
        assert numbers.right_triangles(spark, limit).where(f"c = {limit}").first()["triangles"] == want
        assert exact.count_pythagorean({"n": [str(limit)]}) == want


def test_prime_powers(spark):
    rng = random.Random(5)
    ns = [1, 2, 4, 6, 2**39, 999983**2, 999999999989, 10**12, 963761198400, *[rng.randrange(1, 10**12) for _ in range(300)], 0, -5, 10**12 + 1, None]
    got = {r["n"]: {x["p"]: x["e"] for x in r["powers"]} for r in numbers.factored(spark.createDataFrame([(n,) for n in ns * 2], "n long")).collect()}
    assert sorted(got) == sorted({n for n in ns if n and 0 < n <= 10**12})
    assert all(math.prod(p**e for p, e in f.items()) == n and all(exact.is_prime(p) for p in f) and exact.factor(n) == f for n, f in got.items())


def test_smallest_numbers_with_so_many_divisors():
    most = 1_000_000
    counts = np.zeros(most, np.int32)
    for d in range(1, most):
        counts[d::d] += 1
    for n_divisors in range(2, 201):
        found = [n for n, _ in exact.fewest(n_divisors)]
        plain = np.flatnonzero(counts == n_divisors)[:3].tolist()
        assert found[: len(plain)] == plain and len(found) == 3 and found == sorted(found)

        def partitions(d, largest):
            yield from ([d, *[]],) if d <= largest and d > 1 else ()
            for f in range(min(d - 1, largest), 1, -1):
                if d % f == 0:
                    yield from ([f, *rest] for rest in partitions(d // f, f))

        primes = [2, 3, 5, 7, 11, 13, 17, 19]
        assert found[0] == min(math.prod(p ** (f - 1) for p, f in zip(primes, part, strict=False)) for part in partitions(n_divisors, n_divisors))


def test_complement_is_exact():
    cases = 0
    for faces in range(2, 13):
        for d in range(1, 61):
            for n in range(d):
                k, left = 1, Fraction(faces - 1, faces)
                while 1 - left**k <= Fraction(n, d):
                    k += 1
                assert exact.complement_prob_mn({"f": [str(faces)], "t": [str(n), str(d)]}) == k
                cases += 1
    assert cases > 19_000


def test_sums_of_two_squares():
    for n in [*range(1, 400), 5**6 * 13**2 * 9 * 4, 10**12]:
        plain = {(a, b) for a in range(1, math.isqrt(n // 2) + 1) for b in [math.isqrt(n - a * a)] if b * b == n - a * a}
        assert exact.two_squares(n) == plain


#: Texts with holes for numbers, one or more for each concept.
HOLES = [
    ("continued_fraction", "with {} levels of {}"), ("custom_binary_op", "{} # {} # {}"), ("modular_exponent", "{} ^ {} divided by {}"), ("constrained_divisor_count", "divisors of {} greater than {}"),
    ("constrained_divisor_count", "odd divisors of {}"), ("divisor_sum_filter", "even divisors of {}"), ("perfect_square_divisible", "below {} by {}"), ("multi_constraint_square", "below {} by {} end {}"),
    ("triangular_filter_count", "below {} multiples of {}"), ("arith_term_filter", "first {} terms, multiples of {}, first term {}, difference {}"), ("lattice_points_circle", "<= {}"), ("lattice_points_circle", "<= {}^2"),
    ("ordered_triple_constraint", "sum to {}"), ("alternating_cubes", "up to {}"), ("complex_eq_solcount", "z^{} ="), ("roots_of_unity_sum", "z^{} = 1, z^{} = 1"), ("inclusion_exclusion_3set", "to {} divisible by {}, {}, or {}"),
    ("telescoping_mn", "k(k+{}) k=1 to {}"), ("constrained_digit_count", "between {} and {} digit sum of {}"), ("count_pythagorean", "at most {}"), ("complement_prob_mn", "{}-sided {}/{}"),
    ("complex_modulus_power", "squared is {}"), ("prime_power_divisors", "exactly {} positive divisors"), ("box_diagonal_sq", "exactly {}"), ("lcm_gcd_system", "{} {} {} {}"),
    ("poly_remainder", "{}x^3 +{}x^2 +{}x +{} = {}"), ("polynomial_sign_intervals", "[{}, {}, {}]"), ("algebraic_system_2eq", "{}x+{}y+{}z={} {}x-{}y+{}z={} {}x+{}y-{}z={}"),
    ("constrained_subset_count", "{}-element {{1, ..., {}}} remainder {} when divided by {}"), ("equalization_fraction", "first {} are full, last is {}/{} full"), ("log_laws", "log_{}({}^{}) - log_{}({})"),
    ("chain_log_laws__ordered_triple_constraint", "log_{}({}^{} / {})"), ("chain_prime_power_divisors__constrained_divisor_count", "exactly {} positive divisors less than {}"),
    ("chain_constrained_divisor_count__modular_exponent", "divisors of {} less than {}: {}^e mod {}"),
]


def _number(rng, kind):
    if kind == "small":
        return str(rng.randrange(1, 30))
    return rng.choice([str(rng.randrange(-3, 40)), str(rng.randrange(0, 5000)), str(rng.randrange(10**9)), str(rng.randrange(2**70)), "0", "1", "007", "+5", "1.5", "", "x", "٣", "9" * 23, "-" + "9" * 30])


def test_ten_thousand_odd_texts_end_without_an_error(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(10_000):
        concept, text = rng.choice(HOLES)
        text = text.format(*[_number(rng, rng.choice(["small", "any"])) for _ in range(text.count("{}") + 2)])
        if rng.random() < 0.1:
            text = "".join(rng.sample(text, len(text)))
        rows.append((rng.choice(HOLES)[0] if rng.random() < 0.05 else concept, text))
    got = _run(spark, rows)
    assert len(got) == len(rows)
    assert {r[2] for r in got.values()} <= {None, "unread", "domain", "overflow", "too_large"}
    assert all((r[0] is None) == (r[2] is not None) and (r[2] not in (None, "overflow") or r[1] is not None) for r in got.values())
    assert sum(r[0] is not None for r in got.values()) > 2000


def test_native_and_exact_values_agree(spark):
    rng = random.Random(12)
    rows = [(c, t.format(*[_number(rng, "small") for _ in range(t.count("{}") + 2)])) for c, t in HOLES for _ in range(60) if c in exact.EXACT and c not in recompute.BY_TRIANGLES + recompute.BY_POWERS]
    names = tuple(dict.fromkeys(c for c, _ in rows))
    table = spark.createDataFrame(rows, "concept string, p string").select("concept", "p", recompute.parsed(names).alias("read"))
    for c in ("powers", "triangles", "smallest", "squares"):
        table = table.selectExpr("*", f"cast(null as {recompute._JOINED[c]}) as {c}")
    agreed = 0
    for r in table.selectExpr("concept", "p", "read", f"{recompute.evaluated(names)} as value").collect():
        if r["value"] is not None:
            assert exact.answer(r["concept"], r["read"]) == (str(r["value"]), None), (r["concept"], r["p"])
            agreed += 1
    assert agreed > 1000


def test_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "ordered_triple_constraint", "sum to 9", "r", "v", "w", 5)], "row_id long, concept string, problem string, read string, value string, `p.q` string, recomputed int")
    (got,) = recompute.with_recomputed(rows).collect()
    assert got.asDict() == {"row_id": 1, "concept": "ordered_triple_constraint", "problem": "sum to 9", "read": "r", "value": "v", "p.q": "w", "recomputed": 7, "exact": "7", "reason": None}
    assert recompute.with_recomputed(rows.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 561, 1105, 2**61 - 1, (2**31 - 1) ** 2, 10**18 + 9, 3215031751])
def test_is_prime(n):
    assert exact.is_prime(n) == (n in (2, 3, 2**61 - 1, 10**18 + 9))
