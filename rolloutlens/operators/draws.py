"""Problems drawn from knob specs: numbers by hash, golds by formulas over the drawn numbers (not over a text), guards as data, composites by composing the parts' formulas.

A draw depends on the seed, the concept, the knob, the id and the attempt only, so it is the same on any cluster and for any order of rows.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlens.functions import numbers
from rolloutlens.functions.numbers import gcd_sql, power_sql

_POOL = [360, 420, 480, 504, 540, 600, 630, 660, 720, 756, 792, 840, 900, 924, 960, 990, 1008, 1080, 1120, 1152, 1260, 1320, 1440, 1560, 1680, 1800, 1980, 2100, 2520]
_GT, _LT = [6, 8, 10, 12, 15, 20, 24, 30], [15, 20, 24, 30, 40, 50, 60]
#: Concept, knob, type, value.
SPECS = [
    ("chain_constrained_divisor_count__modular_exponent", "num_pool", "choice", _POOL),
    ("chain_constrained_divisor_count__modular_exponent", "cond", "choice", ["odd", "gt", "lt"]),
    ("chain_constrained_divisor_count__modular_exponent", "gt_thresholds", "choice", _GT),
    ("chain_constrained_divisor_count__modular_exponent", "lt_thresholds", "choice", _LT),
    ("chain_constrained_divisor_count__modular_exponent", "a", "randint", [2, 9]),
    ("chain_constrained_divisor_count__modular_exponent", "m", "randint", [50, 299]),
    ("chain_log_laws__ordered_triple_constraint", "N", "randint", [8, 25]),
    ("chain_log_laws__ordered_triple_constraint", "base", "choice", [2, 3, 5]),
    ("chain_log_laws__ordered_triple_constraint", "e3", "randint", [3, 8]),
    ("chain_prime_power_divisors__constrained_divisor_count", "D", "choice", [12, 14, 15, 16, 18, 20, 24, 27, 28, 30, 32, 36, 40, 48]),
    ("chain_prime_power_divisors__constrained_divisor_count", "cond", "choice", ["gt", "lt"]),
    ("chain_prime_power_divisors__constrained_divisor_count", "gt_thresholds", "choice", [4, 5, 6, 7, 8, 9, 10, 12, 14, 15, 18, 20, 24, 30]),
    ("chain_prime_power_divisors__constrained_divisor_count", "lt_thresholds", "choice", [10, 12, 15, 18, 20, 24, 28, 30, 36, 40, 48, 60]),
    ("complex_modulus_power", "cand_range", "const", [20, 600]),
    ("complex_modulus_power", "rep_cap", "const", [1, 3]),
    ("constrained_divisor_count", "num_pool", "choice", _POOL),
    ("constrained_divisor_count", "cond", "choice", ["odd", "gt", "lt"]),
    ("constrained_divisor_count", "gt_thresholds", "choice", _GT),
    ("constrained_divisor_count", "lt_thresholds", "choice", _LT),
    ("constrained_subset_count", "n", "randint", [7, 11]),
    ("constrained_subset_count", "mod", "choice", [3, 4]),
    ("divisor_sum_filter", "n", "randint", [105, 3000]),
    ("divisor_sum_filter", "cond", "choice", ["odd", "even"]),
    ("inclusion_exclusion_3set", "U", "randint", [200, 900]),
    ("inclusion_exclusion_3set", "divisor_triples", "choice", [[2, 3, 5], [3, 4, 5], [2, 5, 7], [3, 5, 7], [2, 3, 7]]),
    ("log_laws", "base", "choice", [2, 3, 5]),
    ("log_laws", "e1", "randint", [10, 16]),
    ("log_laws", "e2", "randint", [10, 16]),
    ("log_laws", "e3", "randint", [3, 8]),
    ("modular_exponent", "a", "randint", [2, 9]),
    ("modular_exponent", "e", "randint", [6, 16]),
    ("modular_exponent", "m", "randint", [50, 299]),
    ("ordered_triple_constraint", "N", "randint", [10, 20]),
    ("prime_power_divisors", "D", "choice", [12, 16, 18, 20, 24, 28, 30, 36, 40, 48, 60, 64, 72, 80, 90, 96]),
    ("triangular_filter_count", "lim", "randint", [800, 6000]),
    ("triangular_filter_count", "k", "choice", [2, 3, 5]),
]


def _column(param: str) -> str:
    """A formula's name for a knob; such names don't tell N from n."""
    return f"k_{param}" if param.islower() else f"k_{param.lower()}_up"


def _divisors(n: str) -> str:
    """All divisors: those up to the root of n and their counterparts."""
    return f"flatten(transform(filter(sequence(1L, cast(sqrt({n}) as bigint)), d -> {n} % d = 0), d -> if(d * d = {n}, array(d), array(d, {n} div d))))"


def _clause_count(n: str) -> str:
    return f"size(filter({_divisors(n)}, d -> case cond when 'odd' then d % 2 = 1 when 'gt' then d > t else d < t end))"


_TRIPLES = "({0} * {0} + 6) div 12".format
_LCM = lambda a, b: f"({a} * {b} div {gcd_sql(a, b)})"
_DESC = "case cond when 'odd' then 'odd' when 'gt' then concat('greater than ', t) else concat('less than ', t) end"
_LOG = "log_{base}({base}^{e1} · {base}^{e2} / {base}^{e3})"


#: Knobs whose value is a list of numbers.
_LISTS = ("cand_range", "rep_cap", "divisor_triples")


@dataclass
class Recipe:
    """How a concept's problem is made of knobs: values named one after another, the gold, the guard over them and ``gold``, wordings with the names of values in braces, and for a
    composite its parts, the knob that is fed and the value that feeds it.
    """

    gold: str
    texts: list[str]
    guard: str = "true"
    values: dict[str, str] = field(default_factory=dict)
    chain: tuple[list[str], str, str] | None = None


#: Knobs are named k_name (numbers; k_n_up for N) and cond, t; x0 and x1 are further draws; smallest is the smallest number with D divisors.
RECIPES = {
    "chain_constrained_divisor_count__modular_exponent": Recipe(
        power_sql("k_a", "e", "k_m"), ["Let e be the number of positive divisors of {k_num_pool} that are {desc}. What is the remainder when {k_a}^e is divided by {k_m}?", "Suppose e counts the positive divisors of {k_num_pool} that are {desc}. Compute {k_a}^e mod {k_m}."],
        "e between 4 and 20 and gold >= 5", {"e": _clause_count("k_num_pool"), "desc": _DESC}, (["constrained_divisor_count", "modular_exponent"], "e", "e"),
    ),
    "chain_log_laws__ordered_triple_constraint": Recipe(
        _TRIPLES("k_n_up"), [f"How many triples of integers with 0≤a<b<c sum to {_LOG}?", f"In how many ways is {_LOG} a sum of integers 0≤a<b<c?"], "low <= high and gold >= 5",
        {"low": "greatest(4L, k_n_up + k_e3 - 20)", "high": "least(20L, k_n_up + k_e3 - 4)", "e1": "low + x0 % greatest(1L, high - low + 1)", "e2": "k_n_up + k_e3 - e1", "e3": "k_e3", "base": "k_base"}, (["log_laws", "ordered_triple_constraint"], "N", "k_n_up"),
    ),
    "chain_prime_power_divisors__constrained_divisor_count": Recipe(
        _clause_count("smallest"), ["Let N be the smallest positive integer with exactly {k_d_up} positive divisors. How many of the divisors of N are {desc}?", "N is the least number that has exactly {k_d_up} positive divisors. Count the divisors of N that are {desc}."],
        "smallest between 60 and 2520 and gold >= 3", {"desc": _DESC}, (["prime_power_divisors", "constrained_divisor_count"], "num_pool", "smallest"),
    ),
    "complex_modulus_power": Recipe(
        "aggregate(pairs, 0L, (s, a) -> s + a + cast(round(sqrt(n - a * a)) as bigint))", ["Sum a+b over all pairs of positive integers a≤b with a²+b²={n}.", "Add up a+b for each way to write {n} as a²+b² with positive a≤b."], "size(pairs) between k_rep_cap_0 and k_rep_cap_1",
        {"n": "k_cand_range_0 + x0 % (k_cand_range_1 - k_cand_range_0)", "pairs": "filter(sequence(1L, cast(sqrt(n / 2) as bigint)), a -> pow(round(sqrt(n - a * a)), 2) = n - a * a and n - a * a >= a * a)"},
    ),
    "constrained_divisor_count": Recipe(_clause_count("k_num_pool"), ["How many positive divisors of {k_num_pool} are {desc}?", "Of the divisors of {k_num_pool}, how many are {desc}?"], "gold >= 3", {"desc": _DESC}),
    "constrained_subset_count": Recipe(
        # for a < b the third number is beyond b and has one remainder
        "aggregate(sequence(1L, k_n - 1), 0L, (s, a) -> s + aggregate(sequence(a + 1, k_n), 0L, (u, b) -> u + (k_n + k_mod - pmod(r - a - b, k_mod)) div k_mod - (b + k_mod - pmod(r - a - b, k_mod)) div k_mod))",
        ["How many 3-element subsets of {{1,...,{k_n}}} have a sum with remainder {r} when divided by {k_mod}?", "How many size-3 subsets of the first {k_n} positive integers have a sum ≡ {r} (mod {k_mod})?"], "gold >= 5", {"r": "x0 % k_mod"},
    ),
    "divisor_sum_filter": Recipe(
        f"aggregate(filter({_divisors('k_n')}, d -> (d % 2 = 1) = (cond = 'odd')), 0L, (s, d) -> s + d)", ["What is the sum of the {cond} positive divisors of {k_n}?", "Add up all {cond} divisors of {k_n}."],
        "size(filter(array(3, 5, 7, 11, 13, 17, 19, 23), p -> k_n % p = 0)) >= 3 and gold >= 15",
    ),
    "inclusion_exclusion_3set": Recipe(
        f"k_u_up div a + k_u_up div b + k_u_up div c - k_u_up div {_LCM('a', 'b')} - k_u_up div {_LCM('a', 'c')} - k_u_up div {_LCM('b', 'c')} + k_u_up div abc", ["How many integers from 1 to {k_u_up} are divisible by {a}, {b}, or {c}?", "Of the numbers 1 to {k_u_up}, how many are divisible by {a}, {b} or {c}?"], "gold >= 10",
        {"a": "k_divisor_triples_0", "b": "k_divisor_triples_1", "c": "k_divisor_triples_2", "ab": _LCM("a", "b"), "abc": _LCM("ab", "c")},
    ),
    "log_laws": Recipe("k_e1 + k_e2 - k_e3", ["Find log_{k_base}({k_base}^{k_e1}) + log_{k_base}({k_base}^{k_e2}) - log_{k_base}({k_base}^{k_e3}).", "Compute log_{k_base}({k_base}^{k_e1} · {k_base}^{k_e2} / {k_base}^{k_e3})."]),
    "modular_exponent": Recipe(power_sql("k_a", "k_e", "k_m"), ["What is the remainder when {k_a}^{k_e} is divided by {k_m}?", "Evaluate {k_a}^{k_e} modulo {k_m}."], "gold >= 5"),
    "ordered_triple_constraint": Recipe(_TRIPLES("k_n_up"), ["How many triples of integers with 0≤a<b<c satisfy a+b+c={k_n_up}?", "How many integer triples 0≤a<b<c sum to {k_n_up}?"], "gold >= 5"),
    "prime_power_divisors": Recipe("smallest", ["What is the smallest positive integer with exactly {k_d_up} positive divisors?", "Find the least number that has exactly {k_d_up} positive divisors."]),
    "triangular_filter_count": Recipe(
        "size(filter(sequence(1L, cast(sqrt(2 * k_lim) as bigint)), n -> n * (n + 1) div 2 < k_lim and n * (n + 1) div 2 % k_k = 0))", ["How many triangular numbers below {k_lim} are divisible by {k_k}?", "Count the triangular numbers under {k_lim} that are multiples of {k_k}."], "gold >= 3",
    ),
}


def spec_table(spark: SparkSession) -> DataFrame:
    """(concept, param, type, value): value as JSON."""
    return spark.createDataFrame([(c, p, t, json.dumps(v)) for c, p, t, v in SPECS], "concept string, param string, type string, value string")


def _hash(seed: int, what: str) -> str:
    """A number of 32 bits for a draw of ``what`` (SQL) by the id and attempt of a row's concept."""
    return f"cast(conv(substring(md5(concat_ws(':', '{int(seed)}', concept, {what}, cast(id as string), cast(attempt as string))), 1, 8), 16, 10) as bigint)"


def _text(wording: str) -> str:
    """A wording with the values of the names in its braces; doubled braces stand for themselves."""
    pieces = [(text, name) for text, name, _, _ in Formatter().parse(wording)]
    return "concat(" + ", ".join(c for text, name in pieces for c in (f"'{text}'", *([f"cast({name} as string)"] if name else []))) + ")"


def _let(values: dict[str, str], body: str) -> str:
    """``body`` with names for values, each found once; a value may use those named before it."""
    for name, value in reversed(values.items()):
        body = f"get(transform(array({value}), {name} -> {body}), 0)"
    return body


#: A drawn problem.
_DRAW = "struct<problem: string, answer: string, knobs: map<string, string>, fed_value: bigint>"
_KNOB = """case when p.type = 'randint' then cast(p.low + {0} % (p.high - p.low + 1) as string) when p.type = 'choice' then get(p.options, cast({0} % greatest(size(p.options), 1) as int)) else p.value end"""


def _drawn(recipe: Recipe, seed: int) -> str:
    """SQL of a draw by a recipe, null where the guard refuses it; over id, concept, attempt, params (a struct for each knob) and smallest_of (the smallest number by its count of divisors)."""
    knobs = f"map_from_entries(transform(params, p -> struct(p.param, {_KNOB.format(_hash(seed, 'p.param'))})))"
    threshold = "cast(case cond when 'gt' then knobs['gt_thresholds'] when 'lt' then knobs['lt_thresholds'] end as bigint)"
    named = {"knobs": knobs, "cond": "trim(knobs['cond'])", "t": threshold, **{f"x{k}": _hash(seed, f"'x{k}'") for k in (0, 1)}}
    for param in sorted({p for _, p, _, _ in SPECS}):
        named[_column(param)] = f"try_cast(knobs['{param}'] as bigint)"
        if param in _LISTS:
            named[f"_{param}"] = f"from_json(knobs['{param}'], 'array<bigint>')"
            named |= {f"{_column(param)}_{k}": f"get(_{param}, {k})" for k in range(3)}
    named["smallest"] = "try_element_at(smallest_of, k_d_up)"
    named |= recipe.values | {"gold": f"cast({recipe.gold} as bigint)"}
    used = "map_filter(knobs, (k, v) -> k not in ('gt_thresholds', 'lt_thresholds') or k = concat(coalesce(cond, ''), '_thresholds'))"
    text = f"case {' '.join(f'when x1 % {len(recipe.texts)} = {k} then {_text(t)}' for k, t in enumerate(recipe.texts))} end"
    fed = recipe.chain[2] if recipe.chain else "null"
    body = f"if(gold is not null and ({recipe.guard}), cast(named_struct('problem', {text}, 'answer', cast(gold as string), 'knobs', {used}, 'fed_value', cast({fed} as bigint)) as {_DRAW}), null)"
    needed, wanted = body, {}
    for name, value in reversed(named.items()):  # only what is used
        if re.search(rf"\b{name}\b", needed):
            wanted, needed = {name: value} | wanted, f"{needed} {value}"
    return _let(wanted, body)


def spec_table(spark: SparkSession) -> DataFrame:
    """(concept, param, type, value): value as JSON."""
    return spark.createDataFrame([(c, p, t, json.dumps(v)) for c, p, t, v in SPECS], "concept string, param string, type string, value string")


def pool_draw(ids: DataFrame, specs: DataFrame, wanted: int = 3, attempts: int = 12, seed: int = 42) -> DataFrame:
    """(id, concept, problem, answer, knobs, components, fed_param, fed_value, turn): of ``attempts`` draws for each row (id, concept) the first ``wanted`` that pass the concept's guard.

    A draw has one value for every knob of the concept, as JSON: randint a whole number from the first to the second value, choice one of the values, const the value itself. knobs are those
    that were used; components, fed_param and fed_value are null for a concept that isn't composed. Rows of a concept without a recipe or spec give nothing; repeated ids draw alike and share
    their turns. An id's draws are made one after another in its row and end with the last that is wanted, so nothing but the ids is dealt out, over as many tasks as a shuffle has.
    """
    spark = ids.sparkSession
    lists = specs.withColumn("options", F.from_json("value", "array<string>"))
    low, high = (F.get("options", F.lit(k)).try_cast("long").alias(n) for k, n in enumerate(("low", "high")))
    by_concept = lists.groupBy("concept").agg(F.sort_array(F.collect_list(F.struct("param", "type", "value", "options", low, high))).alias("params"))  # a row for each concept, a knob each
    counts = specs.where("param = 'D'").select(F.explode(F.from_json("value", "array<bigint>")).alias("n_divisors"))
    smallest = numbers.by_divisors(counts).select(F.struct("n_divisors", F.col("smallest").try_cast("long").alias("smallest")).alias("s"))
    smallest_of = smallest.agg(F.map_from_entries(F.collect_list("s")).alias("smallest_of"))  # an entry for each divisor count of the specs
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ids.where(F.col("concept").isin(*RECIPES)).select("id", "concept").repartition(n_tasks, "id", "concept").groupBy("id", "concept").agg(F.count("*").alias("copies"))
    rows = rows.join(F.broadcast(by_concept), "concept").crossJoin(F.broadcast(smallest_of))
    cases = " ".join(f"when '{concept}' then {_drawn(recipe, seed)}" for concept, recipe in RECIPES.items())
    passed = f"aggregate(sequence(0, {attempts} - 1), cast(array() as array<{_DRAW}>), (found, attempt) -> if(copies * size(found) >= {wanted}, found, concat(found, array_compact(array(case concept {cases} end)))))"
    turns = f"transform(filter(sequence(0, {wanted} - 1), k -> k < copies * size(found)), k -> named_struct('r', get(found, cast(k div copies as int)), 'turn', k + 1))"
    drawn = rows.select("id", "concept", "copies", F.expr(passed).alias("found")).select("id", "concept", F.expr(f"inline({turns})"))
    chains = {c: r.chain for c, r in RECIPES.items() if r.chain}
    by_chain = lambda of, kind: F.coalesce(*[F.when(F.col("concept") == c, of(chain)) for c, chain in chains.items()]).cast(kind)
    parts, fed = by_chain(lambda x: F.array(*map(F.lit, x[0])), "array<string>"), by_chain(lambda x: F.lit(x[1]), "string")
    return drawn.select("id", "concept", "r.problem", "r.answer", "r.knobs", parts.alias("components"), fed.alias("fed_param"), "r.fed_value", "turn")
