"""Golds worked out again from the text of a problem, concept by concept.

Three steps, each total: no text and no number in it ends a job.

* ``parse`` names what is read from the text ``p``, as digits of any length: a map from names to lists of strings, null where the text doesn't fit (reason ``unread``).
* ``value`` computes with those names (q.name, 64-bit numbers) as a SQL expression where ``safe`` says that nothing can overflow and no list gets long.
* All other rows go, in the same pass over Arrow batches, to ``functions.exact``: whole numbers and fractions of any size. It tells the digits, or why there is no answer:
  ``domain`` (the numbers allow none), ``too_large`` (the bounds of ``exact`` would be passed). An answer that 64 bits can't hold has the reason ``overflow`` beside its digits.

Divisors come from a table of prime powers, joined by number (up to 10^12); "the smallest number with so many divisors" and counts of right triangles are tables that are joined too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloutlens.functions import exact, numbers
from rolloutlens.functions.numbers import gcd_sql, power_sql
from rolloutlens.sources.files import scratch

# The patterns below are fixed values: they must read the same texts.


def _read(*patterns: str, group: int = 1) -> str:
    """What the first of the patterns that fits has in its group."""
    found = [f"nullif(regexp_extract(p, r'{x}', {group}), '')" for x in patterns]
    return f"coalesce({', '.join(found)})" if len(found) > 1 else found[0]


_ALL = "regexp_extract_all(p, r'-?\\d+', 0)"


def _nth(k: int) -> str:
    return f"get({_ALL}, {k})"


_LAST = f"try_element_at({_ALL}, -1)"

#: Kinds of what is read: a number (plain text here), a flag, a list of numbers, a list of texts, a bound (a number that may be cut to 64 bits).
FLAG, LIST, TEXTS, BOUND = "flag", "list", "texts", "bound"


def _count(low: str, high: str, test: str, name: str = "x") -> str:
    """How many whole numbers from low to high pass."""
    return f"if({high} < {low}, 0L, cast(size(filter(sequence({low}, greatest({low}, {high})), {name} -> {test})) as bigint))"


def _reduced(numerator: str, denominator: str) -> str:
    """Numerator plus denominator in lowest terms."""
    return f"({numerator} + {denominator}) div {gcd_sql(numerator, denominator)}"


_DIVISORS = numbers.divisors("powers")
#: The condition of a divisor count: odd or even by word, or a bound.
_CLAUSE = {"odd": (FLAG, "p like '%odd%'"), "even": (FLAG, "p like '%even%'"), "over": (BOUND, _read(r"greater than (\d+)")), "under": (BOUND, _read(r"less than (\d+)"))}
_CHAIN_CLAUSE = _CLAUSE | {"even": (FLAG, "false")}
_CLAUSE_TEST = "case when q.odd then x % 2 = 1 when q.even then x % 2 = 0 when q.over is not null then x > q.over else x < q.under end"
_HAS_CLAUSE = "(q.odd or q.even or q.over is not null or q.under is not null)"
_CLAUSED = f"cast(size(filter({_DIVISORS}, x -> {_CLAUSE_TEST})) as bigint)"
#: The exponent of a power of q.base, else null; doubles are exact up to 9 x 10^15.
_EXPONENT = "if({0} <= 9000000000000000 and pow(q.base, round(ln({0}) / ln(q.base))) = {0}, cast(round(ln({0}) / ln(q.base)) as bigint), null)".format


def _log_sum(argument: str) -> str:
    """The exponents of an argument added up, those after a slash taken off: factors are numbers or powers."""
    factor = "if(t like '%^%', try_cast(round(pow(try_cast(split_part(t, '^', 1) as double), try_cast(split_part(t, '^', 2) as double))) as bigint), try_cast(t as bigint))"
    tokens = f"regexp_extract_all(concat('*', regexp_replace({argument}, '[×·]', '*')), r'([*/])\\s*([0-9^]+)', {{}})"
    signed = f"zip_with({tokens.format(1)}, transform({tokens.format(2)}, t -> {_EXPONENT(factor)}), (o, e) -> if(o = '/', -e, e))"
    return f"aggregate({signed}, 0L, (s, e) -> s + e)"


_LOG_FORM = r"rlike r'^\s*\d{1,15}(\^\d{1,3})?(\s*[×·*/]\s*\d{1,15}(\^\d{1,3})?)*\s*$'"
_TRIPLES = "({0} * {0} + 6) div 12".format  # 0 <= a < b < c with a given sum
_LOG_TERM = r"([+\-]?)\s*log[_\s]*(?:base\s*)?\{?\d+\}?\s*(?:of\s+(\d+)|\(([^)]*)\))"
_SIGNED = "replace(replace(p, 'plus', '+'), 'minus', '-')"
_EQUATION = r"(-?\d+)x([+-]\d+)y([+-]\d+)z=(-?\d+)"
_EQUATIONS = [f"regexp_extract_all(replace(p, ' ', ''), r'{_EQUATION}', {g})" for g in (1, 2, 3, 4)]


def _determinant(columns: tuple[int, int, int]) -> str:
    """Of the 3 x 3 matrix with these columns of q.m, three rows of four numbers one after another."""
    a = [[f"q.m[{4 * r + c}]" for c in columns] for r in range(3)]
    minor = lambda c, d: f"({a[1][c]} * {a[2][d]} - {a[1][d]} * {a[2][c]})"
    return f"({a[0][0]} * {minor(1, 2)} - {a[0][1]} * {minor(0, 2)} + {a[0][2]} * {minor(0, 1)})"


_DET, _SUM_DETS = _determinant((0, 1, 2)), f"({_determinant((3, 1, 2))} + {_determinant((0, 3, 2))} + {_determinant((0, 1, 3))})"
#: A polynomial equation without spaces, x³ and x² as such; and a number of it.
_EQUALITY = "regexp_replace(regexp_replace(regexp_replace(replace(p, ' ', ''), r'\\^3', '³'), r'\\^2', '²'), 'equals?', '=')"
_IN_EQUALITY = ("nullif(regexp_extract(" + _EQUALITY + ", r'{}', 1), '')").format
_DIFFERENCE, _SECOND = _read(r"difference (\d+)", r"increasing by (\d+)"), _read(r"sequence \d+, *(\d+)")
_MULTIPLE = _read(r"(?:multiples of|divisible by) (\d+)")
_NO_NULL = "not exists({0}, x -> x is null)".format
_ROOTS = "cast(size(filter(sequence(1L, greatest(1L, cast(sqrt(q.n) as bigint))), x -> x * x < q.n and {})) as bigint)".format

#: concept: (what is read, its value, when that is safe).
CONCEPTS: dict[str, tuple[dict[str, str | tuple[str, str]], str, str]] = {
    "continued_fraction": (
        {
            "x": _read(r"value of\s*(\d+)\s*\+\s*1\s*/", r"levels of (\d+)", r"repeats (\d+) for", r"built from (\d+)", r"total (\d+).?s"),
            "depth": f"coalesce(if(p rlike r'value of\\s*\\d+\\s*\\+\\s*1\\s*/', cast(size(regexp_extract_all(replace(p, ' ', ''), r'(\\d+)\\+1/', 1)) + 1 as string), null), {_read(r'with (\d+) levels', r'for (\d+) levels', r'(\d+)-level', r'with (\d+) total')})",
        },
        "aggregate(if(q.depth > 1, sequence(2L, q.depth), array()), named_struct('n', q.x, 'd', 1L), (s, i) -> named_struct('n', q.x * s.n + s.d, 'd', s.n), s -> s.n + s.d)",
        "q.x >= 1 and q.depth between 1 and 60 and pow(q.x + 1D, q.depth + 1D) < 4e18",
    ),
    "custom_binary_op": ({"xs": (LIST, _ALL)}, "aggregate(q.xs, 1L, (s, x) -> s * (x + 1)) - 1", f"size(q.xs) >= 2 and {_NO_NULL('q.xs')} and aggregate(q.xs, 1D, (s, x) -> s * (abs(double(x)) + 1)) < 9e18"),
    "modular_exponent": ({"a": _nth(0), "b": _nth(1), "m": _nth(2)}, power_sql("q.a", "q.b", "q.m"), "q.a >= 0 and q.b >= 0 and q.m between 1 and 3000000000"),
    "constrained_divisor_count": ({"n": _read(r"divisors of (\d+)"), **_CLAUSE}, _CLAUSED, f"powers is not null and {_HAS_CLAUSE}"),
    "divisor_sum_filter": ({"n": _LAST, "odd": (FLAG, "lower(p) like '%odd%'")}, f"aggregate(filter({_DIVISORS}, x -> (x % 2 = 1) = q.odd), 0L, (s, x) -> s + x)", "powers is not null"),
    "perfect_square_divisible": ({"n": _nth(0), "m": _nth(1)}, _ROOTS("x * x % q.m = 0"), "q.n between 0 and 1000000000 and q.m >= 1"),
    "multi_constraint_square": ({"n": _nth(0), "m": _nth(1), "d": _nth(2)}, _ROOTS("x * x % q.m = 0 and x * x % 10 = q.d"), "q.n between 0 and 1000000000 and q.m >= 1 and q.d is not null"),
    "triangular_filter_count": (
        {"n": _read(r"(?:below|less than|under) (\d+)"), "m": _MULTIPLE},
        _count("1L", "cast(sqrt(2 * q.n) as bigint)", "x * (x + 1) div 2 < q.n and x * (x + 1) div 2 % q.m = 0"), "q.n <= 1000000000 and q.m >= 1",
    ),
    "arith_term_filter": (
        {
            "n": _read(r"first (\d+) terms"), "m": _MULTIPLE, "a": _read(r"first term (\d+)", r"starts at (\d+)", r"beginning (\d+)", r"sequence (\d+), *\d+"),
            "d": _DIFFERENCE, "second": _SECOND, "step": f"coalesce({_DIFFERENCE}, {_SECOND})",
        },
        _count("0L", "q.n - 1", "(q.a + x * coalesce(q.d, q.second - q.a)) % q.m = 0"), "q.n <= 30000 and q.m >= 1 and q.a <= 1000000000000 and q.step <= 1000000000000",
    ),
    "lattice_points_circle": (
        {"r": _read(r"[≤<]=?\s*(\d+)"), "squared": (FLAG, r"p rlike r'[≤<]=?\s*\d+\s*(²|\^2)'")},
        "transform(array(if(q.squared, q.r * q.r, q.r)), r -> aggregate(sequence(-cast(sqrt(r) as bigint), cast(sqrt(r) as bigint)), 0L, (s, x) -> s + 2 * cast(sqrt(r - x * x) as bigint) + 1))[0]",
        "q.r <= if(q.squared, 10000, 100000000)",
    ),
    "ordered_triple_constraint": ({"n": _read(r"a\+b\+c\s*=\s*(\d+)", r"sum to (\d+)", r"(\d+) be written as a\+b\+c")}, _TRIPLES("q.n"), "q.n <= 3000000000"),
    "alternating_cubes": ({"xs": (LIST, _ALL)}, "transform(array(greatest(0L, array_max(q.xs) div 2)), k -> k * k * (4 * k + 3))[0]", f"{_NO_NULL('q.xs')} and array_max(q.xs) <= 2000000"),
    "complex_eq_solcount": ({"n": _read(r"z\^?(\d+)\s*=")}, "q.n + 2", "q.n < 9000000000000000000"),
    "roots_of_unity_sum": (
        {k: f"coalesce(get(regexp_extract_all(p, r'z\\^(\\d+)\\s*=\\s*1', 1), {i}), get(regexp_extract_all(p, r'(\\d+)(?:th|st|nd|rd)', 1), {i}))" for i, k in enumerate("ab")},
        gcd_sql("q.a", "q.b"), "q.a is not null and q.b is not null",
    ),
    "inclusion_exclusion_3set": (
        {"n": _read(r"to (\d+)"), **{k: _read(r"divisible by (\d+),\s*(\d+),?\s*(?:or|and)?\s*(\d+)", group=i) for i, k in enumerate("abc", 1)}},
        _count("1L", "q.n", "x % q.a = 0 or x % q.b = 0 or x % q.c = 0"), "q.n <= 3000 and q.a >= 1 and q.b >= 1 and q.c >= 1",
    ),
    # 1 / (k (k + d)) for k = 1..n telescopes to n / (d j (n + j)) for j = 1..d, added up as fractions
    "telescoping_mn": (
        {"d": _read(r"k\s*\(\s*k\s*\+\s*(\d+)\s*\)"), "n": _read(r"k\s*=\s*1\s*(?:\.\.|to|…|,\s*\.\.\.,)\s*(\d+)", r"for k\s*=\s*1[^\d]{1,6}(\d+)")},
        f"aggregate(sequence(1L, q.d), named_struct('n', 0L, 'd', 1L), (s, j) -> named_struct('n', s.n * j * (q.n + j) + q.n * s.d, 'd', s.d * j * (q.n + j)), s -> {_reduced('s.n', 's.d * q.d')})",
        "q.d between 1 and 4 and q.n <= 1000",
    ),
    "constrained_digit_count": (
        {"a": _read(r"between (\d+) and", r"\[(\d+),", r"from (\d+) to"), "b": _read(r"between \d+ and (\d+)", r"\[\d+,\s*(\d+)\]", r"from \d+ to (\d+)"), "s": _read(r"digit sum (?:of|is|equal to|to) (\d+)", r"digits sum to (\d+)", r"sum of (?:the )?digits (?:is |of |equal to )?(\d+)")},
        _count("q.a", "q.b", "aggregate(split(cast(x as string), ''), 0L, (s, c) -> s + coalesce(try_cast(c as bigint), 0L)) = q.s"), "q.s is not null and q.b - q.a <= 10000 and q.b < 1000000000000",
    ),
    "count_pythagorean": ({"n": _LAST}, "triangles", "triangles is not null"),
    "complement_prob_mn": ({"f": _read(r"(\d+)-(?:sided|faced)"), "t": (TEXTS, r"if(p rlike r'\d+/\d+', array(regexp_extract(p, r'(\d+)/(\d+)', 1), regexp_extract(p, r'(\d+)/(\d+)', 2)), array('1', '2'))")}, "0L", "false"),
    "complex_modulus_power": (
        {"xs": (LIST, _ALL)},
        "transform(array(array_max(q.xs)), n -> aggregate(sequence(1L, cast(sqrt(n / 2) as bigint) + 1), 0L, (s, a) -> if(n - a * a >= a * a and pow(round(sqrt(n - a * a)), 2) = n - a * a, s + a + cast(round(sqrt(n - a * a)) as bigint), s)))[0]",
        f"{_NO_NULL('q.xs')} and array_max(q.xs) between 1 and 100000000",
    ),
    "prime_power_divisors": ({"d": f"coalesce({_read(r'exactly (\d+) positive divisors')}, {_LAST})"}, "try_cast(smallest as bigint)", "true"),
    "box_diagonal_sq": ({"d": f"coalesce({_read(r'exactly (\d+)')}, '4')"}, "try_cast(squares as bigint)", "true"),
    "lcm_gcd_system": (
        {"a": _nth(0), "l": _nth(1), "b": _nth(2), "g": _nth(3)},
        f"get(filter(sequence(1L, q.l), x -> q.l % x = 0 and q.a * x = q.l * {gcd_sql('q.a', 'x')} and {gcd_sql('x', 'q.b')} = q.g), 0)",
        "q.l between 1 and 10000 and q.a between 1 and 1000000000 and q.b is not null and q.g is not null",
    ),
    "poly_remainder": (
        {
            "a": _IN_EQUALITY(r"(-?\d+)x³"), "b": _IN_EQUALITY(r"(-?\d+)x²"), "c": _IN_EQUALITY(r"(-?\d+)x(?![²³\d])"),
            "d": f"coalesce({_IN_EQUALITY(r'x([+-]\d+)=')}, '0')", "v": _IN_EQUALITY(r"=(-?\d+)"),
        },
        "get(filter(sequence(1L, 2999L), x -> q.a * x * x * x + q.b * x * x + q.c * x + q.d = q.v), 0)",
        "abs(q.a) <= 10000000 and abs(q.b) <= 10000000 and abs(q.c) <= 10000000 and abs(q.d) <= 1000000000000 and q.v is not null",
    ),
    "polynomial_sign_intervals": (
        {"m": (TEXTS, r"transform(if(p rlike r'\[[\d,\s]+\]', split(regexp_extract(p, r'\[([\d,\s]+)\]', 1), ','), regexp_extract_all(p, r'\)\s*\^\s*\(?\s*(\d+)', 1)), x -> trim(x))")},
        "cast(size(filter(sequence(0, size(q.m)), t -> size(filter(slice(q.m, t + 1, size(q.m)), m -> right(m, 1) in ('1', '3', '5', '7', '9'))) % 2 = 0)) as bigint)",
        "size(q.m) <= 200 and forall(q.m, x -> x rlike r'^\\d+$')",
    ),
    "algebraic_system_2eq": (
        {"m": (LIST, f"flatten(transform(sequence(0, 2), r -> array({', '.join(f'get({e}, r)' for e in _EQUATIONS)})))"), "third": f"get({_EQUATIONS[3]}, 2)"},
        f"if({_DET} = 0 or {_SUM_DETS} % nullif({_DET}, 0) <> 0, null, {_SUM_DETS} div nullif({_DET}, 0))", f"{_NO_NULL('q.m')} and forall(q.m, x -> abs(x) <= 100000)",
    ),
    # subsets by size and remainder, one element after another
    "constrained_subset_count": (
        {
            "k": _read(r"(\d+)-element", r"size-?\s?(\d+)"), "n": _read(r"\{1[^}]*?(\d+)\}", r"first (\d+) positive"),
            "r": _read(r"remainder (\d+) when", r"≡\s*(\d+)", r"(\d+)\s*more than"), "m": _read(r"divided by (\d+)", r"mod\s*(\d+)", r"multiple of (\d+)"),
        },
        "aggregate(sequence(1L, q.n), transform(sequence(0L, q.k), j -> transform(sequence(0L, q.m - 1), s -> if(j = 0 and s = 0, 1L, 0L))),"
        " (acc, i) -> transform(acc, (row, j) -> transform(row, (c, s) -> c + if(j = 0, 0L, get(get(acc, j - 1), cast(pmod(s - i, q.m) as int))))), acc -> get(get(acc, cast(q.k as int)), cast(q.r % q.m as int)))",
        "q.n between 1 and 60 and q.k <= q.n and q.m between 1 and 50 and q.n * q.k * q.m <= 20000 and q.r is not null",
    ),
    "equalization_fraction": (
        {"k": _read(r"first (\d+) are full", r"(\d+) completely full", r"(?<![/\d])(\d+) full"), "a": _read(r"(\d+)/\d+ full", r"(?:at|last is|one) (\d+)/\d+"), "b": _read(r"\d+/(\d+) full", r"(?:at|last is|one) \d+/(\d+)")},
        _reduced("(q.b - q.a)", "(q.b * (q.k + 1))"), "q.b between 1 and 1000000000 and q.a <= 1000000000 and q.k <= 1000000000",
    ),
    "log_laws": (
        {
            "base": _read(r"log[_\s]*(?:base\s*)?\{?(\d+)\}?"), "signs": (TEXTS, f"regexp_extract_all({_SIGNED}, r'{_LOG_TERM}', 1)"),
            "arguments": (TEXTS, f"zip_with(regexp_extract_all({_SIGNED}, r'{_LOG_TERM}', 2), regexp_extract_all({_SIGNED}, r'{_LOG_TERM}', 3), (a, b) -> if(a <> '', a, b))"),
        },
        f"aggregate(zip_with(q.signs, q.arguments, (s, a) -> if(s = '-', -1L, 1L) * {_log_sum('a')}), 0L, (u, x) -> u + x)", f"q.base between 2 and 1000000 and forall(q.arguments, a -> a {_LOG_FORM})",
    ),
    "chain_log_laws__ordered_triple_constraint": (
        {"base": _read(r"log[_\s]*\{?(\d+)\}?"), "arguments": (TEXTS, r"array(nullif(regexp_extract(p, r'log[_\s]*\{?\d+\}?\s*\(([^)]*)\)', 1), ''))")},
        f"transform(array({_log_sum('q.arguments[0]')}), n -> if(n < 0, null, {_TRIPLES('n')}))[0]", f"q.base between 2 and 1000000 and q.arguments[0] {_LOG_FORM}",
    ),
    "chain_prime_power_divisors__constrained_divisor_count": ({"d": _read(r"exactly (\d+) positive divisors"), **_CHAIN_CLAUSE}, _CLAUSED, f"powers is not null and {_HAS_CLAUSE}"),
    "chain_constrained_divisor_count__modular_exponent": (
        {"n": _read(r"divisors of (\d+)"), **_CHAIN_CLAUSE, "a": _read(r"(\d+)\s*\^\s*e\b"), "m": _read(r"(?:divided by|mod)\s+(\d+)")},
        power_sql("q.a", _CLAUSED, "q.m"), f"powers is not null and {_HAS_CLAUSE} and q.a is not null and q.m between 1 and 3000000000",
    ),
}

#: Concepts that need the prime powers of the number they read as n, those that ask by a divisor count d, and those that look up a count of triangles.
BY_POWERS = ("constrained_divisor_count", "divisor_sum_filter", "chain_constrained_divisor_count__modular_exponent")
BY_COUNT = ("prime_power_divisors", "box_diagonal_sq", "chain_prime_power_divisors__constrained_divisor_count")
BY_TRIANGLES = ("count_pythagorean",)
#: Names that a text may leave out.
_OPTIONAL = {"over", "under", "d of arith_term_filter", "second"}
_JOINED = {"powers": "array<struct<p: bigint, e: int>>", "triangles": "bigint", "smallest": "string", "squares": "string", "why": "string"}


def _kind(what: str | tuple[str, str]) -> tuple[str, str]:
    return what if isinstance(what, tuple) else ("number", what)


def parsed(concepts: tuple[str, ...]) -> Column:
    """What the text ``p`` says under its concept, as map<string, array<string>>; null if it doesn't fit."""
    cases = []
    for name in concepts:
        pairs = ", ".join(f"'{k}', " + (f"coalesce({sql}, array())" if kind in (LIST, TEXTS) else f"array(cast({sql} as string))") for k, (kind, sql) in ((k, _kind(v)) for k, v in CONCEPTS[name][0].items()))
        needed = [k for k in CONCEPTS[name][0] if k not in _OPTIONAL and f"{k} of {name}" not in _OPTIONAL]
        all_there = " and ".join(f"get(r['{k}'], 0) is not null" for k in needed)
        cases.append(f"when '{name}' then transform(array(map({pairs})), r -> if({all_there}, map_filter(r, (k, v) -> get(v, 0) is not null), null))[0]")
    # the text is bound once: a filter pushed below would otherwise copy it to every pattern
    return F.expr(f"transform(array(p), p -> case concept {' '.join(cases)} end)[0]")


def evaluated(concepts: tuple[str, ...]) -> str:
    """The value of ``read`` (a map of ``parsed``) under its concept where that is safe, else null."""
    cases = []
    for name in concepts:
        parse, value, safe = CONCEPTS[name]
        fields = []
        for k, what in parse.items():
            first = f"get(read['{k}'], 0)"
            cut = f"if({first} is null, null, coalesce(try_cast({first} as bigint), 9223372036854775807L))"
            fields.append(f"'{k}', " + {FLAG: f"{first} = 'true'", LIST: f"transform(read['{k}'], x -> try_cast(x as bigint))", TEXTS: f"read['{k}']", BOUND: cut}.get(_kind(what)[0], f"try_cast({first} as bigint)"))
        cases.append(f"when '{name}' then transform(array(named_struct({', '.join(fields)})), q -> if(coalesce({safe}, false), cast({value} as bigint), null))[0]")
    return f"case concept {' '.join(cases)} end"


_RESULT = ("recomputed", "exact", "reason")


def _completed(found: DataFrame, concepts: tuple[str, ...]) -> DataFrame:
    """``found`` (_row, concept, read, value, told, why) as (_row, recomputed, exact, reason): rows without a value are worked out exactly, a batch without such rows passes as it is."""
    schema = found.select("_row").schema.add("recomputed", "long").add("exact", "string").add("reason", "string")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            concept, told, why = (batch.column(c).to_pylist() for c in ("concept", "told", "why"))
            value = batch.column("value").to_pylist()
            read = batch.column("read")
            digits = [str(v) if v is not None else t for v, t in zip(value, told, strict=True)]
            reasons: list[str | None] = [None] * len(value)
            for k in [k for k, v in enumerate(value) if v is None]:
                if not read[k].is_valid:
                    reasons[k] = "unread" if concept[k] in concepts else "unknown_concept"
                elif concept[k] in exact.EXACT:
                    digits[k], reasons[k] = exact.answer(concept[k], dict(read[k].as_py()))
                elif digits[k] is None:
                    reasons[k] = why[k] or "domain"
                if digits[k] is not None:
                    value[k] = int(digits[k])
                    if not -(2**63) <= value[k] < 2**63:
                        value[k], reasons[k] = None, "overflow"
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(value, pa.int64()), pa.array(digits, pa.string()), pa.array(reasons, pa.string())], ["_row", *_RESULT])

    return found.mapInArrow(finish, schema)


def with_recomputed(rows: DataFrame) -> DataFrame:
    """``rows`` (concept, problem, ...) with recomputed, exact (its digits) and reason (why recomputed is null). Columns of these names are replaced; a null text or concept is no error.

    Texts are parsed once and written to the shared folder with their rows: the tables of prime powers, divisor counts and triangles are made from what was read, and planning stays short.
    """
    spark = rows.sparkSession
    quoted = [F.col(f"`{c}`") for c in rows.columns if c not in _RESULT]
    asked = rows.select(F.struct(*quoted).alias("_row"), F.col("concept").cast("string").alias("concept"), F.coalesce(F.col("problem").cast("string"), F.lit("")).alias("p"))
    path = scratch(spark, "parsed")
    asked.select("_row", "concept", parsed(tuple(CONCEPTS)).alias("read")).write.parquet(path)
    every = spark.read.parquet(path)
    special = BY_POWERS + BY_COUNT + BY_TRIANGLES
    others = tuple(c for c in CONCEPTS if c not in special)

    def group(names: tuple[str, ...], k: str) -> DataFrame:
        return every.where(F.col("concept").isin(*names)).withColumn("n", F.get(F.col("read")[k], F.lit(0)).try_cast("long"))

    powered, counted, cornered = group(BY_POWERS, "n"), group(BY_COUNT, "d"), group(BY_TRIANGLES, "n")
    largest = powered.select(F.lit(0).alias("k"), "n").where(F.col("n").between(1, numbers.MOST_FACTORED)).union(cornered.select(F.lit(1), "n").where(F.col("n").between(0, numbers.MOST_TABLED)))
    most = {r["k"]: r["n"] for r in largest.groupBy("k").agg(F.max("n").alias("n")).collect()}  # two rows

    joined = [every.where(~F.coalesce(F.col("concept"), F.lit("")).isin(*special))]
    joined.append(powered.join(numbers.factored(powered.select("n"), most[0]), "n", "left") if 0 in most else powered)
    joined.append(cornered.join(numbers.right_triangles(spark, most[1]).withColumnRenamed("c", "n"), "n", "left") if 1 in most else cornered)
    counts = numbers.by_divisors(counted.select(F.col("n").alias("n_divisors")))
    joined.append(counted.join(counts.withColumnsRenamed({"n_divisors": "n", "reason": "why"}), "n", "left"))

    out = None
    for part, names in zip(joined, (others, BY_POWERS, BY_TRIANGLES, BY_COUNT), strict=True):
        part = part.withColumns({c: F.lit(None).cast(t) for c, t in _JOINED.items() if c not in part.columns})
        told = F.expr("case concept when 'prime_power_divisors' then smallest when 'box_diagonal_sq' then squares end")
        why = F.coalesce("why", F.when(F.col("smallest").isNull() | (F.col("concept").contains("chain") & F.col("powers").isNull()), "too_large")) if names is BY_COUNT else F.col("why")
        done = part.select("_row", "concept", "read", F.expr(evaluated(names)).alias("value"), told.alias("told"), why.alias("why"))
        out = done if out is None else out.union(done)
    return _completed(out, tuple(CONCEPTS)).select("_row.*", *_RESULT)
