"""Golds held against what their texts say, for all concepts of ``functions.recompute``: texts in several phrasings made from ``part``, gate, repair and report.

The oracles don't read the texts: they work the golds out from the numbers the texts were made of, mostly by another formula.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlens.functions.numbers import gcd_sql
from rolloutlens.functions.recompute import CONCEPTS, with_recomputed
from rolloutlens.sources import views

_S = "cast({} as string)".format


def _text(*parts: str) -> str:
    """Literals and, with a leading =, SQL numbers, in one string."""
    return "concat(" + ", ".join(_S(p[1:]) if p[0] == "=" else "'" + p + "'" for p in parts) + ")"


def _either(*texts: str) -> str:
    """One phrasing after the other by turns."""
    return f"case k % {len(texts)} " + " ".join(f"when {i} then {t}" for i, t in enumerate(texts)) + " end"


_SUM = "coalesce(list_sum(list_transform(range({}, {}), lambda {}: {})), 0)".format
_LEN = "len(list_filter(range({}, {}), lambda {}: {}))".format
_POWER = "list_reduce(list_prepend(1::bigint, list_transform(range(0, {1}), lambda i: {0})), lambda s, x: s * x % ({2})) % ({2})".format
_CF = {2: "x * x + 1 + x", 3: "x * x * x + 2 * x + x * x + 1", 4: "x * x * x * x + 3 * x * x + 1 + x * x * x + 2 * x", 5: "x * x * x * x * x + 4 * x * x * x + 3 * x + x * x * x * x + 3 * x * x + 1"}
_CLAUSED = "case k % 4 when 0 then d % 2 = 1 when 1 then d % 2 = 0 when 2 then d > {t} else d < {t} end".format
_CLAUSE = lambda t: _either("' that are odd?'", "' that are even?'", _text(" greater than ", f"={t}", "?"), _text(" less than ", f"={t}", "?"))
#: The smallest number with 2 to 12 divisors.
_SMALLEST = "case {} when 2 then 2 when 3 then 4 when 4 then 6 when 5 then 16 when 6 then 12 when 7 then 64 when 8 then 24 when 9 then 36 when 10 then 48 when 11 then 1024 else 60 end".format

#: concept: (the problem's text, the oracle's gold), both SQL over u, v, w (numbers of a row) and k (its phrasing).
FIXTURES: dict[str, tuple[str, str]] = {
    "continued_fraction": (
        _either(
            f"concat('What is the value of ', case u % 4 + 2 when 2 then {_text('=v % 7 + 2', '+1/', '=v % 7 + 2')} when 3 then {_text('=v % 7 + 2', '+1/(', '=v % 7 + 2', '+1/', '=v % 7 + 2', ')')} when 4 then "
            f"{_text('=v % 7 + 2', '+1/(', '=v % 7 + 2', '+1/(', '=v % 7 + 2', '+1/', '=v % 7 + 2', '))')} else {_text('=v % 7 + 2', '+1/(', '=v % 7 + 2', '+1/(', '=v % 7 + 2', '+1/(', '=v % 7 + 2', '+1/', '=v % 7 + 2', ')))')} end, '? Give numerator plus denominator.')",
            _text("A nested fraction with ", "=u % 4 + 2", " levels of ", "=v % 7 + 2", " is reduced."), _text("A fraction repeats ", "=v % 7 + 2", " for ", "=u % 4 + 2", " levels."),
            _text("Reduce the ", "=u % 4 + 2", "-level continued fraction built from ", "=v % 7 + 2", "."),
        ),
        f"(select case u % 4 + 2 {' '.join(f'when {d} then {f}' for d, f in _CF.items())} end from (select v % 7 + 2 as x))",
    ),
    "custom_binary_op": (_text("Let x#y = x+y+xy. Find ((", "=u % 9 + 1", "#", "=v % 9 + 1", ")#", "=w % 9 + 1", ")."), "(u % 9 + 2) * (v % 9 + 2) * (w % 9 + 2) - 1"),
    "modular_exponent": (_text("What remains when ", "=u % 40 + 2", "^", "=v % 9 + 2", " is divided by ", "=w % 90 + 3", "?"), f"(select {_POWER('u % 40 + 2', 'v % 9 + 2', 'w % 90 + 3')})"),
    "constrained_divisor_count": (f"concat({_text('How many positive divisors of ', '=u % 900 + 60')}, {_CLAUSE('v % 30 + 3')})", _LEN("1", "u % 900 + 61", "d", f"(u % 900 + 60) % d = 0 and {_CLAUSED(t='v % 30 + 3')}")),
    "divisor_sum_filter": (_either(_text("Add up the odd divisors of ", "=u % 900 + 60", "."), _text("Add up the even divisors of ", "=u % 900 + 60", ".")), _SUM("1", "u % 900 + 61", "d", "case when (u % 900 + 60) % d = 0 and d % 2 = 1 - k % 2 then d else 0 end")),
    "perfect_square_divisible": (_text("How many squares below ", "=u % 5000 + 100", " are multiples of ", "=v % 12 + 2", "?"), _LEN("1", "u % 5000 + 100", "s", "s % (v % 12 + 2) = 0 and pow(round(sqrt(s)), 2) = s")),
    "multi_constraint_square": (_text("How many squares below ", "=u % 5000 + 100", " are multiples of ", "=v % 6 + 2", " and end in ", "=w % 10", "?"), _LEN("1", "u % 5000 + 100", "s", "s % (v % 6 + 2) = 0 and s % 10 = w % 10 and pow(round(sqrt(s)), 2) = s")),
    "triangular_filter_count": (_either(_text("Triangular numbers under ", "=u % 5000 + 100", " divisible by ", "=v % 12 + 2", "?"), _text("Count triangular numbers below ", "=u % 5000 + 100", " that are multiples of ", "=v % 12 + 2", ".")), _LEN("1", "u % 5000 + 100", "s", "s % (v % 12 + 2) = 0 and pow(round(sqrt(8 * s + 1)), 2) = 8 * s + 1")),
    "arith_term_filter": (
        _either(
            _text("Of the first ", "=u % 40 + 5", " terms of a sequence with first term ", "=v % 20 + 1", " and common difference ", "=w % 9 + 1", ", how many are divisible by ", "=u % 7 + 2", "?"),
            _text("A sequence starts at ", "=v % 20 + 1", " with common difference ", "=w % 9 + 1", ". How many of its first ", "=u % 40 + 5", " terms are multiples of ", "=u % 7 + 2", "?"),
            _text("In a row beginning ", "=v % 20 + 1", " and increasing by ", "=w % 9 + 1", ", which of the first ", "=u % 40 + 5", " terms are multiples of ", "=u % 7 + 2", "?"),
            _text("The sequence ", "=v % 20 + 1", ", ", "=v % 20 + 1 + w % 9 + 1", ", ... goes on. How many of the first ", "=u % 40 + 5", " terms are divisible by ", "=u % 7 + 2", "?"),
        ),
        f"(select {_LEN('a', 'a + n * d', 't', '(t - a) % d = 0 and t % m = 0')} from (select v % 20 + 1 as a, w % 9 + 1 as d, u % 40 + 5 as n, u % 7 + 2 as m))",
    ),
    "lattice_points_circle": (_either(_text("How many lattice points have x²+y² ≤ ", "=u % 60 + 3", "?"), _text("How many lattice points have x²+y² ≤ ", "=u % 9 + 2", "²?"), _text("Points with x^2+y^2 <= ", "=u % 9 + 2", "^2?")),
        f"(select {_SUM('-r', 'r + 1', 'x', _LEN('-r', 'r + 1', 'y', 'x * x + y * y <= b'))} from (select b, cast(sqrt(b) as bigint) + 1 as r from (select case when k % 3 = 0 then u % 60 + 3 else (u % 9 + 2) * (u % 9 + 2) end as b)))"),
    "ordered_triple_constraint": (_either(_text("Triples 0≤a<b<c with a+b+c = ", "=u % 40 + 3", "?"), _text("How many triples a<b<c sum to ", "=u % 40 + 3", "?"), _text("In how many ways can ", "=u % 40 + 3", " be written as a+b+c with a<b<c?")),
        f"(select {_SUM('0', 's', 'a', _LEN('a + 1', 's', 'b', 's - a - b > b'))} from (select u % 40 + 3 as s))"),
    "alternating_cubes": (_text("Find -1^3 + 2^3 - ... up to ", "=2 * (u % 30) + 4", " cubed."), "(select 2 * n * (n + 1) * (2 * n + 1) - 3 * n * (n + 1) + n from (select u % 30 + 2 as n))"),
    "complex_eq_solcount": (_text("How many complex numbers satisfy z^", "=u % 30 + 2", " = conj(z)?"), "u % 30 + 4"),
    "roots_of_unity_sum": (_either(_text("How many z have z^", "=u % 60 + 2", " = 1 and z^", "=v % 60 + 2", " = 1?"), _text("How many are both a ", "=u % 60 + 2", "th and a ", "=v % 60 + 2", "th root of unity?")), "gcd(u % 60 + 2, v % 60 + 2)"),
    "inclusion_exclusion_3set": (_text("How many of 1 to ", "=u % 900 + 60", " are divisible by ", "=v % 5 + 2", ", ", "=v % 7 + 3", ", or ", "=w % 11 + 5", "?"), _LEN("1", "u % 900 + 61", "d", "d % (v % 5 + 2) = 0 or d % (v % 7 + 3) = 0 or d % (w % 11 + 5) = 0")),
    "telescoping_mn": (_either(_text("Sum 1/(k(k+", "=v % 3 + 1", ")) for k=1 to ", "=u % 30 + 2", " as m/n; m+n?"), _text("Add 1/(k(k+", "=v % 3 + 1", ")) with k=1..", "=u % 30 + 2", "; m+n?")),
        "(select (a + b) // gcd(a, b) from (select cast(case d when 1 then n when 2 then 3 * n * n + 5 * n else n * (11 * n * n + 48 * n + 49) end as bigint) as a, cast(case d when 1 then n + 1 when 2 then 4 * (n + 1) * (n + 2) else 18 * (n + 1) * (n + 2) * (n + 3) end as bigint) as b from (select u % 30 + 2 as n, v % 3 + 1 as d)))"),
    "constrained_digit_count": (_either(_text("How many whole numbers between ", "=u % 300 + 1", " and ", "=u % 300 + 500", " have digit sum ", "of ", "=w % 12 + 3", "?"), _text("From the range [", "=u % 300 + 1", ", ", "=u % 300 + 500", "], whose digits sum to ", "=w % 12 + 3", "?"), _text("Going from ", "=u % 300 + 1", " to ", "=u % 300 + 500", ", where is the sum of the digits ", "=w % 12 + 3", "?")),
        _LEN("u % 300 + 1", "u % 300 + 501", "n", "n % 10 + n // 10 % 10 + n // 100 = w % 12 + 3")),
    "count_pythagorean": (_text("How many right triangles have whole sides and a hypotenuse of at most ", "=u % 40 + 5", "?"), f"(select {_SUM('1', 'c + 1', 'z', _LEN('1', 'z', 'a', '2 * a * a <= z * z and pow(round(sqrt(z * z - a * a)), 2) = z * z - a * a'))} from (select u % 40 + 5 as c))"),
    "complement_prob_mn": (_either(_text("How often must a fair ", "=u % 18 + 3", "-sided die be rolled for a better than 1/2 chance?"), _text("How often must a ", "=u % 18 + 3", "-faced die be rolled for a chance above 3/4?")), "cast(floor(ln(case when k % 2 = 0 then 0.5 else 0.25 end) / ln((u % 18 + 2) / (u % 18 + 3))) as bigint) + 1"),
    "complex_modulus_power": (_text("Sum a+b over 0<a<=b with |a+bi|^2 = ", "=(u % 12 + 1) * (u % 12 + 1) + (v % 12 + 1) * (v % 12 + 1)", "."), f"(select {_SUM('1', 's', 'a', _SUM('a', 's', 'b', 'case when a * a + b * b = n then a + b else 0 end'))} from (select n, cast(sqrt(n) as bigint) + 2 as s from (select (u % 12 + 1) * (u % 12 + 1) + (v % 12 + 1) * (v % 12 + 1) as n)))"),
    "prime_power_divisors": (_text("What is the smallest whole number with exactly ", "=u % 11 + 2", " positive divisors?"), _SMALLEST("u % 11 + 2")),
    "box_diagonal_sq": (_text("A box has the three smallest whole edges with exactly ", "=u % 5 + 2", " divisors each; its diagonal squared?"), "case u % 5 + 2 when 2 then 38 when 3 then 16 + 81 + 625 when 4 then 36 + 64 + 100 when 5 then 256 + 6561 + 390625 else 144 + 324 + 400 end"),
    "lcm_gcd_system": (_text("With ", "=u % 8 + 2", " it has a least common multiple of ", "=lcm_ax", ", with ", "=w % 20 + 2", " a greatest common divisor of ", "=gcd_xb", "."), "list_filter(range(1, lcm_ax + 1), lambda x: lcm(x, u % 8 + 2) = lcm_ax and gcd(x, w % 20 + 2) = gcd_xb)[1]"),
    "poly_remainder": (_either(_text("For which x is ", "=u % 4 + 1", "x^3 + ", "=v % 5 + 1", "x^2 + ", "=w % 6 + 1", "x + ", "=u % 9 + 1", " = ", "=value", "?"), _text("Solve ", "=u % 4 + 1", "x³ +", "=v % 5 + 1", "x² +", "=w % 6 + 1", "x +", "=u % 9 + 1", " = ", "=value", ".")), "v % 50 + 1"),
    "polynomial_sign_intervals": (_either(_text("Roots 1, 2, 3 have multiplicities [", "=u % 4 + 1", ", ", "=v % 4 + 1", ", ", "=w % 4 + 1", "]: positive intervals?"), _text("Where is (x-1)^", "=u % 4 + 1", "(x-2)^", "=v % 4 + 1", "(x-3)^", "=w % 4 + 1", " positive?")),
        "(select 1 + cast(pow(-1, c) = 1 as int) + cast(pow(-1, b + c) = 1 as int) + cast(pow(-1, a + b + c) = 1 as int) from (select u % 4 + 1 as a, v % 4 + 1 as b, w % 4 + 1 as c))"),
    "algebraic_system_2eq": (_text("=u % 3 + 2", "x+1y+1z=", "=(u % 3 + 2) * (u % 9 - 4) + v % 9 + w % 9", "; 1x+", "=v % 3 + 3", "y-1z=", "=u % 9 - 4 + (v % 3 + 3) * (v % 9) - w % 9", "; 1x-1y+", "=w % 3 + 4", "z=", "=u % 9 - 4 - v % 9 + (w % 3 + 4) * (w % 9)", ". Find x+y+z."), "u % 9 - 4 + v % 9 + w % 9"),
    "constrained_subset_count": (_either(_text("How many 3-element subsets of {1, ..., ", "=u % 9 + 5", "} have a sum with remainder ", "=v % 4", " when divided by ", "=v % 4 + 2", "?"), _text("Subsets of size 3 of the first ", "=u % 9 + 5", " positive numbers with a sum ≡ ", "=v % 4", " (mod ", "=v % 4 + 2", ")?")),
        f"(select {_SUM('1', 'n + 1', 'a', _SUM('a + 1', 'n + 1', 'b', _LEN('b + 1', 'n + 1', 'c', '(a + b + c) % m = r % m')))} from (select u % 9 + 5 as n, v % 4 + 2 as m, v % 4 as r))"),
    "equalization_fraction": (_either(_text("The first ", "=u % 9 + 2", " are full and the last is ", "=v % 5 + 1", "/", "=v % 5 + 2 + w % 4", " full; pour evenly."), _text("There are ", "=u % 9 + 2", " completely full glasses and one ", "=v % 5 + 1", "/", "=v % 5 + 2 + w % 4", " full.")),
        "(select (a + b) // gcd(a, b) from (select w % 4 + 1 as a, (v % 5 + 2 + w % 4) * (u % 9 + 3) as b))"),
    "log_laws": (_either(_text("Find log_", "=b", "(", "=b", "^", "=v % 9 + 1", " · ", "=b", "^", "=w % 5 + 1", ") - log_", "=b", "(", "=b * b", ")."), _text("Find log base ", "=b", " of ", "=b * b * b", " plus log base ", "=b", " of ", "=b", " minus log base ", "=b", " of ", "=b * b", "."), _text("log_", "=b", "(", "=b", "^", "=v % 9 + 1", "/", "=b * b", ") is?")), "case k % 3 when 0 then v % 9 + w % 5 when 1 then 2 else v % 9 - 1 end"),
    "chain_log_laws__ordered_triple_constraint": (_text("Count a<b<c with sum log_", "=b", "(", "=b", "^", "=v % 9 + 5", " · ", "=b", "^", "=w % 9 + 3", " / ", "=b", "^2)."), f"(select {_SUM('0', 's', 'a', _LEN('a + 1', 's', 'b2', 's - a - b2 > b2'))} from (select v % 9 + w % 9 + 6 as s))"),
    "chain_prime_power_divisors__constrained_divisor_count": (f"concat({_text('Take the smallest whole number with exactly ', '=u % 11 + 2', ' positive divisors. How many of its divisors are')}, {_CLAUSE('v % 9 + 2')})", f"(select case when k % 4 <> 1 then {_LEN('1', 'n + 1', 'd', 'n % d = 0 and ' + _CLAUSED(t='v % 9 + 2'))} end from (select {_SMALLEST('u % 11 + 2')} as n))"),
    "chain_constrained_divisor_count__modular_exponent": (f"concat({_text('Let e be the number of divisors of ', '=u % 300 + 12')}, replace({_CLAUSE('v % 9 + 2')}, '?', ''), {_text('. What is ', '=w % 7 + 2', '^e mod ', '=u % 50 + 3', '?')})",
        f"(select case when k % 4 <> 1 then {_POWER('w % 7 + 2', 'e', 'u % 50 + 3')} end from (select {_LEN('1', 'n + 1', 'd', 'n % d = 0 and ' + _CLAUSED(t='v % 9 + 2'))} as e from (select u % 300 + 12 as n)))"),
}


#: Numbers of a row: u, v and w, a phrasing k, a base b, and what some texts need besides.
_NUMBERS = """select row_id, c, u, v, w, k, u % 4 + 2 as b, (u % 4 + 1) * x * x * x + (v % 5 + 1) * x * x + (w % 6 + 1) * x + u % 9 + 1 as value, (u % 8 + 2) * y div {gcd_ay} as lcm_ax, {gcd_yb} as gcd_xb
from (select p_partkey as row_id, p_partkey % {n} as c, p_partkey as u, p_size + p_partkey % 13 as v, p_partkey % 31 + 3 * p_size as w, cast(floor(p_partkey / {n}) as bigint) as k,
  (p_size + p_partkey % 13) % 50 + 1 as x, cast((p_size + p_partkey % 13) % 6 + 1 as bigint) as y from @part) r"""
_SPARK_NUMBERS = _NUMBERS.format(n=len(FIXTURES), gcd_ay=gcd_sql("cast(u % 8 + 2 as bigint)", "y"), gcd_yb=gcd_sql("cast(w % 20 + 2 as bigint)", "y"))
_DUCKDB_NUMBERS = _NUMBERS.replace(" div ", " // ").format(n=len(FIXTURES), gcd_ay="gcd(u % 8 + 2, y)", gcd_yb="gcd(w % 20 + 2, y)")
_NAME = "case c " + " ".join(f"when {i} then '{name}'" for i, name in enumerate(FIXTURES)) + " end"
#: Stored golds: one in eleven is one too high, one in 37 no number.
_STORED = "case when row_id % 37 = 0 then 'n/a' else cast(gold + case when row_id % 11 = 0 then 1 else 0 end as string) end"

#: The golds by the oracle's formulas, without a text.
GOLDS = f"select row_id, {_NAME} as concept, cast(case c {' '.join(f'when {i} then {gold}' for i, (_, gold) in enumerate(FIXTURES.values()))} end as bigint) as recomputed from ({_DUCKDB_NUMBERS}) n"
_GOLDS_STORED = f"select row_id, concept, recomputed, {_STORED} as answer from (select *, coalesce(recomputed, 0) as gold from ({GOLDS}) g) s"


#: Why a text gives no 64-bit gold, where its concept is known.
REASONS = ("unread", "domain", "overflow", "too_large")


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, concept, problem): a text for each row of ``part``, the concepts by turns."""
    texts = f"case c {' '.join(f'when {i} then {text}' for i, (text, _) in enumerate(FIXTURES.values()))} end"
    return views.query(spark, sf_dir, f"select row_id, {_NAME} as concept, {texts} as problem from ({_SPARK_NUMBERS}) n")


def recompute_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-1 stands for a text that can't be read."""
    return with_recomputed(problems(spark, sf_dir)).select("row_id", "concept", F.coalesce("recomputed", F.lit(-1).cast("long")).alias("recomputed"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_recomputed(problems(spark, sf_dir)).withColumn("gold", F.coalesce("recomputed", F.lit(0).cast("long"))).withColumn("answer", F.expr(_STORED)).drop("gold")


def mismatch(answer: Column, gold: Column) -> Column:
    """A stored gold that is no number, or another one."""
    return F.coalesce(F.abs(answer.try_cast("double") - gold) > 1e-6, F.lit(True))


def report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By concept: rows, rows whose text gave a gold, bad golds among those, why the others gave none, and what that says."""
    bad = F.col("recomputed").isNotNull() & mismatch(F.col("answer"), F.col("recomputed"))
    why = [F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in REASONS]
    counts = _stored(spark, sf_dir).groupBy("concept").agg(F.count("*").alias("n"), F.count("recomputed").alias("checked"), F.count_if(bad).alias("bad"), *why)
    flag = F.when(F.col("checked") == 0, "unchecked").when(2 * F.col("bad") > F.col("checked"), "checker_suspect").when(F.col("bad") > 0, "bad_golds").otherwise("ok")
    return counts.withColumn("flag", flag)


#: Every text of the fixtures can be read; one that asks for even divisors in a chain has no answer there.
_REPORT_SQL = f"""select concept, n, checked, bad, 0::bigint as n_unread, n - checked as n_domain, 0::bigint as n_overflow, 0::bigint as n_too_large,
  case when checked = 0 then 'unchecked' when 2 * bad > checked then 'checker_suspect' when bad > 0 then 'bad_golds' else 'ok' end as flag
from (select concept, count(*) as n, count(recomputed) as checked, count(*) filter (where recomputed is not null and (answer = 'n/a' or cast(recomputed as string) <> answer)) as bad from ({_GOLDS_STORED}) g group by concept) c"""


def examples(spark: SparkSession, sf_dir: str, most: int = 25) -> DataFrame:
    """The first bad golds, for the end of the report: at most ``most`` rows (row_id, concept, answer, recomputed)."""
    bad = _stored(spark, sf_dir).where(F.col("recomputed").isNotNull() & mismatch(F.col("answer"), F.col("recomputed")))
    return bad.select("row_id", "concept", "answer", "recomputed").orderBy("row_id").limit(most)


_EXAMPLES_SQL = f"select row_id, concept, answer, recomputed from ({_GOLDS_STORED}) g where recomputed is not null and (answer = 'n/a' or cast(recomputed as string) <> answer) order by row_id limit 25"


#: The number a of a row in 128 bits: products with it pass 64 bits, the squares from keys of some 300,000 on.
_WIDE = "cast(a as decimal(19, 0))"
#: Texts over long numbers, made of the numbers a, b and c of a row; the oracle has 128 bits.
_LONG = {
    "custom_binary_op": (_text("Let x#y = x+y+xy. Find ((", "=a + 100000", "#", "=b + 200000", ")#", "=c + 300000", ")#", "=a + 400000", "."), "(a + 100001)::hugeint * (b + 200001) * (c + 300001) * (a + 400001) - 1"),
    "alternating_cubes": (_text("Find -1^3 + 2^3 - ... up to ", f"=2 * ({_WIDE} * 100003 + b)", " cubed."), "(a * 100003 + b)::hugeint * (a * 100003 + b) * (4 * (a * 100003 + b) + 3)"),
    "complex_eq_solcount": (_text("How many complex numbers satisfy z^", "=a + 1", "000000000000000000000 = conj(z)?"), "(a + 1) * 1000000000000000000000::hugeint + 2"),
    # divisors of 2^i 3^j 5^k 7^l: all, and the odd ones
    "constrained_divisor_count": (_text("How many positive divisors of ", "=shiftleft(1L, a % 12 + 1) * case b % 4 when 0 then 1L when 1 then 3L when 2 then 9L else 27L end * case c % 3 when 0 then 1L when 1 then 5L else 25L end * 2401L", " are odd?"), "((b % 4 + 1) * (c % 3 + 1) * 5)::hugeint"),
    "divisor_sum_filter": (_text("Add up the odd divisors of ", "=shiftleft(1L, a % 12 + 1) * case b % 4 when 0 then 1L when 1 then 3L when 2 then 9L else 27L end * 823543L", "."), "((case b % 4 when 0 then 1 when 1 then 4 when 2 then 13 else 40 end) * 960800)::hugeint"),
    "prime_power_divisors": (_text("What is the smallest whole number with exactly ", "=case a % 8 when 0 then 13 when 1 then 17 when 2 then 19 when 3 then 23 when 4 then 43 when 5 then 61 when 6 then 67 else 101 end", " positive divisors?"), "power(2::hugeint, case a % 8 when 0 then 12 when 1 then 16 when 2 then 18 when 3 then 22 when 4 then 42 when 5 then 60 when 6 then 66 else 100 end)::hugeint"),
    "modular_exponent": (_text("What remains when ", "=a % 1000 + 2", "^1099511627776 is divided by ", "=b + 3", "?"), "list_reduce(list_prepend((a % 1000 + 2)::hugeint % (b + 3), range(0, 40)::hugeint[]), lambda s, x: s * s % (b + 3))"),
    "ordered_triple_constraint": (_text("How many triples a<b<c sum to ", f"={_WIDE} * 1000000007 + b", "?"), "((a * 1000000007 + b)::hugeint * (a * 1000000007 + b) + 6) // 12"),
    "perfect_square_divisible": (_text("How many squares below ", f"=({_WIDE} + 5) * ({_WIDE} + 5)", "00000000 are multiples of ", "=72", "?"), "((a + 5)::hugeint * 10000 - 1) // 12"),
    "modular_exponent_by_zero": (_text("What remains when ", "=a", "^", "=b", " is divided by 0?"), "null::hugeint"),
}
_LONG_NUMBERS = "select p_partkey as row_id, p_partkey as a, p_size + p_partkey % 13 as b, p_partkey % 31 + 3 * p_size as c, p_partkey % {n} as k from @part".format(n=len(_LONG))
_LONG_NAME = "replace(case k " + " ".join(f"when {i} then '{name}'" for i, name in enumerate(_LONG)) + " end, '_by_zero', '')"


def recompute_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over long numbers: the digits of the gold (- without one) and why 64 bits have none (- otherwise)."""
    texts = f"case k {' '.join(f'when {i} then {text}' for i, (text, _) in enumerate(_LONG.values()))} end"
    done = with_recomputed(views.query(spark, sf_dir, f"select row_id, {_LONG_NAME} as concept, {texts} as problem from ({_LONG_NUMBERS}) n"))
    return done.select("row_id", "concept", F.coalesce("exact", F.lit("-")).alias("digits"), F.coalesce("reason", F.lit("-")).alias("reason"))


_LONG_SQL = f"""select row_id, concept, coalesce(g::varchar, '-') as digits, case when g is null then 'domain' when g > 9223372036854775807 then 'overflow' else '-' end as reason
from (select row_id, {_LONG_NAME} as concept, case k {' '.join(f'when {i} then {gold}' for i, (_, gold) in enumerate(_LONG.values()))} end as g from ({_LONG_NUMBERS}) n) x"""


def gate(rows: DataFrame) -> DataFrame:
    """(concept, ok, detail) for ``rows`` (row_id, concept, problem, answer, recomputed): each text counts once, by its first row.

    ok is null where nothing can read the concept and no text has two golds; false with conflicting golds, with no readable text, or with a mismatch.
    """
    known = F.col("concept").isin(*CONCEPTS)
    texts = rows.groupBy("concept", "problem").agg(F.min_by("answer", "row_id").alias("answer"), F.first("recomputed").alias("gold"), F.count_distinct(F.coalesce("answer", F.lit(""))).alias("golds"))
    bad = F.col("gold").isNotNull() & mismatch(F.col("answer"), F.col("gold"))
    sums = texts.groupBy("concept").agg(F.count("*").alias("n"), F.count("gold").alias("checked"), F.count_if(F.col("golds") > 1).alias("conflicts"), F.count_if(bad).alias("bad"))
    ok = F.when(F.col("conflicts") > 0, False).when(~known, F.lit(None).cast("boolean")).otherwise((F.col("checked") > 0) & (F.col("bad") == 0))
    cover = F.concat(F.col("checked"), F.lit("/"), F.col("n"), F.lit(" read"))
    detail = (
        F.when((F.col("conflicts") > 0) & ~known, F.concat(F.col("conflicts"), F.lit(" conflicting golds, no way to recompute")))
        .when(~known, "unchecked: no way to recompute")
        .when(F.col("conflicts") > 0, F.concat(F.col("conflicts"), F.lit(" conflicting golds, "), cover))
        .when(F.col("checked") == 0, F.concat(cover, F.lit(": nothing would be verified")))
        .otherwise(F.concat(F.col("bad"), F.lit(" mismatches, "), cover))
    )
    return sums.select("concept", ok.alias("ok"), detail.alias("detail"))


#: Rows for the gate: every third concept keeps its right golds, one concept has a name that nothing can read.
_GATED = "case when concept = 'log_laws' then 'unknown_concept' else concept end"
_CLEAN = "case when length(concept) % 3 = 0 then cast(recomputed as string) else answer end"


def gate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_recomputed(problems(spark, sf_dir)).withColumn("gold", F.coalesce("recomputed", F.lit(0).cast("long"))).withColumn("answer", F.expr(_STORED))
    return gate(rows.withColumn("answer", F.expr(_CLEAN)).withColumn("problem", F.concat("problem", F.lit(" #"), "row_id")).withColumn("concept", F.expr(_GATED))).withColumn("ok", F.coalesce(F.col("ok").cast("string"), F.lit("unknown")))


_GATE_SQL = f"""select concept, case when concept = 'unknown_concept' then 'unknown' else cast(checked > 0 and bad = 0 as varchar) end as ok,
  case when concept = 'unknown_concept' then 'unchecked: no way to recompute' when checked = 0 then concat(checked, '/', n, ' read: nothing would be verified') else concat(bad, ' mismatches, ', checked, '/', n, ' read') end as detail
from (select {_GATED} as concept, count(*) as n, count(recomputed) as checked, count(*) filter (where recomputed is not null and (a = 'n/a' or cast(recomputed as string) <> a)) as bad
  from (select *, {_CLEAN} as a from ({_GOLDS_STORED}) g) h group by 1) s"""


def repair(rows: DataFrame, concept: str = "continued_fraction") -> DataFrame:
    """``rows`` (row_id, concept, problem, answer, recomputed) with the concept's golds set right where the text could be read, each text once by its first row; and whether a gold was changed."""
    wrong = (F.col("concept") == concept) & F.col("recomputed").isNotNull() & (F.coalesce("answer", F.lit("")) != F.col("recomputed").cast("string"))
    mended = rows.select("row_id", "concept", "problem", F.when(wrong, F.col("recomputed").cast("string")).otherwise(F.col("answer")).alias("answer"), wrong.alias("changed"))
    firsts = mended.groupBy("problem").agg(F.min_by(F.struct("row_id", "concept", "answer", "changed"), "row_id").alias("r"))
    return firsts.select("r.row_id", "r.concept", "problem", "r.answer", "r.changed")


def repair_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(_repairable(spark, sf_dir)).select("row_id", "concept", "answer", "changed")


def _repairable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).withColumn("problem", F.concat("concept", F.lit(" "), F.expr("row_id div 64")))


def repair_report(spark: SparkSession, sf_dir: str, concept: str = "continued_fraction") -> DataFrame:
    """One row: rows of the concept, golds that were set right, texts that gave none, and all rows before and after each text counts once."""
    rows = _repairable(spark, sf_dir)
    own = F.col("concept") == concept
    wrong = own & F.col("recomputed").isNotNull() & (F.coalesce("answer", F.lit("")) != F.col("recomputed").cast("string"))
    return rows.agg(F.count_if(own).alias("n"), F.count_if(wrong).alias("fixed"), F.count_if(own & F.col("recomputed").isNull()).alias("unparsed"), F.count("*").alias("n_before"), F.count_distinct("problem").alias("n_after"))


_REPAIR_REPORT_SQL = f"""select count(*) filter (where concept = 'continued_fraction') as n, count(*) filter (where concept = 'continued_fraction' and recomputed is not null and answer <> cast(recomputed as string)) as fixed,
  count(*) filter (where concept = 'continued_fraction' and recomputed is null) as unparsed, count(*) as n_before, count(distinct concept || ' ' || (row_id // 64)) as n_after from ({_GOLDS_STORED}) g"""
_REPAIR_SQL = f"""select row_id, concept, case when wrong then cast(recomputed as string) else answer end as answer, wrong as changed from (select *, concept = 'continued_fraction' and recomputed is not null and answer <> cast(recomputed as string) as wrong,
  row_number() over (partition by concept, row_id // 64 order by row_id) as r from ({_GOLDS_STORED}) g) x where r = 1"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "recompute_all": (recompute_all, f"select row_id, concept, coalesce(recomputed, -1) as recomputed from ({GOLDS}) g"),
    "recompute_all_report": (report_all, _REPORT_SQL),
    "recompute_examples": (examples, _EXAMPLES_SQL),
    "recompute_long": (recompute_long, _LONG_SQL),
    "repair_report": (repair_report, _REPAIR_REPORT_SQL),
    "gate_golds_all": (gate_all, _GATE_SQL),
    "repair_golds": (repair_golds, _REPAIR_SQL),
}
