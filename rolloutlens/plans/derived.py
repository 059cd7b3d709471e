"""Queries whose Spark form and oracle differ: grader variants, text measures, recomputed golds, chains, files and streams.

Each entry is (Spark query, oracle). The Spark side is a function of (spark, sf_dir); the oracle is SQL in which @name is a table or view.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlens.functions import failures
from rolloutlens.functions import grading as G
from rolloutlens.sources import files, views
from rolloutlens.streaming import jobs

KEYS = ["problem_id", "arm", "rollout_idx"]


def _rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frame(spark, sf_dir, "rollouts")


# --- grader variants -------------------------------------------------------------------------------------------------

_LABEL = "case rollout_idx % 3 when 0 then gold when 1 then concat('Steps first. #### 1,', gold) else response end"
_FRACTION = "concat(case when rollout_idx % 2 = 0 then '-' else '' end, chr(92), 'frac{', case when rollout_idx % 3 = 0 then '-' else '' end, gold, '}{', cast(rollout_idx + 1 as string), '}')"


def gold_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollouts(spark, sf_dir).select(*KEYS, G.gold_answer(F.expr(_LABEL)).alias("answer"))


_GOLD_SQL = rf"""select problem_id, arm, rollout_idx, case when regexp_matches(trim(x), '{G.PLAIN_GOLD}') then trim(x) else replace(nullif(regexp_extract(x, '{G.HASHES}', 1), ''), ',', '') end as answer
from (select *, {_LABEL} as x from @rollouts)"""


def frac_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollouts(spark, sf_dir).select(*KEYS, G.clean_fraction(F.expr(_FRACTION)).alias("plain"))


_FRACTION_SQL = f"""select problem_id, arm, rollout_idx, concat(cast(case when rollout_idx % 2 = 0 then -1 else 1 end * case when rollout_idx % 3 = 0 then -1 else 1 end * cast(gold as bigint) as string), '/', cast(rollout_idx + 1 as string)) as plain from @rollouts"""

_BOXED_TEXT = "case when doc_id % 2 = 0 then concat(text, chr(92), 'boxed{7}') else text end"
_WORDS = "list_filter(string_split_regex({}, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')".format


def format_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", G.format_reward(F.expr(_BOXED_TEXT)).alias("reward"))


_FORMAT_SQL = f"""select doc_id, case when len({_WORDS('x')}) <= 30 then -0.2::double when regexp_matches(x, '{G.PLAIN_BOXED}') then 0.1::double else 0.0::double end as reward from (select doc_id, {_BOXED_TEXT} as x from @documents)"""


def total_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = views.frame(spark, sf_dir, "graded")
    return graded.select(*KEYS, (F.when(F.col("ok"), 1.0).otherwise(0.0) + G.format_reward(F.col("response"))).alias("reward"))


_TOTAL_SQL = f"""select problem_id, arm, rollout_idx, case when ok then 1e0 else 0e0 end + case when len({_WORDS('response')}) <= 30 then -0.2::double when regexp_matches(response, '{G.PLAIN_BOXED}') then 0.1::double else 0e0 end as reward from @graded"""


def grade_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollouts(spark, sf_dir).withColumn("f", G.predicted_lenient(F.col("response"))).select(*KEYS, "f.pred", "f.method", G.numbers_match(F.col("f.pred"), F.col("gold")).alias("ok"))


def _lenient_sql() -> str:
    positive = lambda p: p.replace("-?", "")
    first = lambda p, g=1: f"regexp_extract_all(response, '{p}', {g})[1]"
    last = lambda p, g=1: f"regexp_extract_all(response, '{p}', {g})[-1]"
    steps = {"boxed": first(G.LENIENT_BOXED), "####": first(positive(G.HASHES)), "the_answer_is": first(positive(G.ANSWER_IS)), "bold": last(positive(G.BOLD)), "last_line_number": last(G.LENIENT_LINE), "last_number_fallback": last(positive(G.NUMBER), 0)}
    raw = f"coalesce({', '.join(steps.values())})"
    method = " ".join(f"when {v} is not null then '{k}'" for k, v in steps.items())
    return f"select problem_id, arm, rollout_idx, pred, method, coalesce(abs(try_cast(pred as double) - try_cast(gold as double)) < 1e-6, false) as ok from (select *, replace({raw}, ',', '') as pred, case {method} else 'no_answer' end as method from @rollouts)"


def _legacy_ok(pred: Column) -> Column:
    return F.coalesce(pred == F.col("gold").try_cast("double").cast("long").cast("string"), F.lit(False))


def grade_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollouts(spark, sf_dir).withColumn("pred", G.predicted_legacy(F.col("response"))).select(*KEYS, "pred", _legacy_ok(F.col("pred")).alias("ok"))


_LEGACY_SQL = rf"""select problem_id, arm, rollout_idx, pred, coalesce(pred = cast(cast(trunc(try_cast(gold as double)) as bigint) as string), false) as ok from (select *, coalesce(cast(cast(trunc(try_cast(b as double)) as bigint) as string), b,
  replace(regexp_extract_all(response, '{G.LEGACY_ANSWER}', 1)[1], ',', ''), regexp_extract_all(response, '-?\d+\.?\d*', 0)[-1]) as pred from (select *, replace(regexp_extract_all(response, '{G.LEGACY_BOXED}', 1)[1], ',', '') as b from @rollouts))"""


def grader_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = views.frame(spark, sf_dir, "graded").withColumn("lenient", G.predicted_lenient(F.col("response"))["pred"]).withColumn("legacy", G.predicted_legacy(F.col("response")))
    flags = {"n_strict": F.col("ok"), "n_lenient": G.numbers_match(F.col("lenient"), F.col("gold")), "n_legacy": _legacy_ok(F.col("legacy"))}
    return graded.groupBy("arm").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])


_ABLATION_SQL = f"""select g.arm, count(*) as n, count(*) filter (where g.ok) as n_strict, count(*) filter (where a.ok) as n_lenient, count(*) filter (where b.ok) as n_legacy from @graded g
  join ({_lenient_sql()}) a using (problem_id, arm, rollout_idx) join ({_LEGACY_SQL}) b using (problem_id, arm, rollout_idx) group by g.arm"""


# --- text measures ---------------------------------------------------------------------------------------------------


def trigram_repetition(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_repeated, ratio): the share of trigram positions whose trigram occurs three times or more; 0 for fewer than five words."""
    none = F.array().cast("array<string>")
    grams = lambda w: F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(none)
    measured = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), G.let(F.sort_array(grams(w)), lambda g: F.struct(F.size(g).alias("n"), failures.in_threes(g).cast("long").alias("r"))).alias("g"))
    m = docs.select("doc_id", G.let(failures.words(F.lower(F.coalesce("text", F.lit("")))), measured).alias("m"))
    return m.select("doc_id", "m.n_words", F.col("m.g.r").alias("n_repeated"), F.coalesce(F.try_divide(F.col("m.g.r").cast("double"), F.col("m.g.n")), F.lit(0.0)).alias("ratio"))


_TRIGRAM_SQL = f"""with w as (select doc_id, {_WORDS("lower(coalesce(text, ''))")} as w from @documents),
g as (select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) as g from w where len(w) >= 5),
c as (select doc_id, g, count(*) as c from g group by doc_id, g),
s as (select doc_id, sum(c) as n, sum(case when c >= 3 then c else 0 end) as r from c group by doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(r, 0) as bigint) as n_repeated, coalesce(cast(r as double) / n, 0e0) as ratio from w left join s on s.doc_id = w.doc_id"""


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, repeated): whether a stripped line of more than 15 characters occurs three times or more."""
    lines = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("x")).select("doc_id", F.btrim("x", F.lit(failures.BLANKS)).alias("x"))
    counts = lines.groupBy("doc_id", "x").agg(F.count("*").alias("c"))
    return counts.groupBy("doc_id").agg(F.max((F.length("x") > 15) & (F.col("c") >= 3)).alias("repeated"))


_LINES_SQL = """select doc_id, bool_or(length(x) > 15 and c >= 3) as repeated from (select doc_id, x, count(*) as c from
  (select doc_id, trim(x, chr(9) || chr(11) || chr(12) || chr(13) || ' ') as x from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x from @documents)) group by doc_id, x) group by doc_id"""


def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many numbers and whole numbers a response holds, and the sum of its numbers."""
    found = F.transform(F.regexp_extract_all("response", F.lit(r"-?\d[\d,]*\.?\d*"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    ints = F.regexp_extract_all("response", F.lit(r"-?\d+"), F.lit(0))
    rows = _rollouts(spark, sf_dir).select(*KEYS, found.alias("x"), F.size(ints).cast("long").alias("n_ints"))
    return rows.select(*KEYS, F.size("x").cast("long").alias("n_numbers"), "n_ints", F.aggregate("x", F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0))).alias("total"))


_NUMBERS_SQL = r"""select problem_id, arm, rollout_idx, cast(len(x) as bigint) as n_numbers, cast(len(regexp_extract_all(response, '-?\d+', 0)) as bigint) as n_ints, coalesce(list_sum(x), 0e0) as total
from (select *, list_transform(regexp_extract_all(response, '-?\d[\d,]*\.?\d*', 0), lambda v: try_cast(replace(v, ',', '') as double)) as x from @rollouts)"""


# --- failures and chains ---------------------------------------------------------------------------------------------


def failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first wrong rollout of each problem and arm, by kind of failure; there is no worked gold solution."""
    rows = failures.first_rollouts(views.frame(spark, sf_dir, "graded"))
    return rows.select("problem_id", "arm", "concept", failures.kind(F.col("method"), F.col("wrong"), F.col("right")).alias("mode"))


_FAILURE_SQL = failures.kind_sql("""select problem_id, arm, concept, arg_min(method, rollout_idx) filter (where not ok) as method, arg_min(response, rollout_idx) filter (where not ok) as wrong, arg_min(response, rollout_idx) filter (where ok) as rightly,
  '' as question, '' as gold_text from @graded group by problem_id, arm, concept having count(*) filter (where not ok) > 0""")


def failure_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failure_modes(spark, sf_dir).groupBy("concept", "mode").agg(F.count("*").alias("n")).select("concept", "mode", "n", F.sum("n").over(_by_concept()).alias("n_classified"))


def _by_concept():
    from pyspark.sql import Window

    return Window.partitionBy("concept")


_FAILURE_FRAC_SQL = f"select concept, mode, n, cast(sum(n) over (partition by concept) as bigint) as n_classified from (select concept, mode, count(*) as n from ({_FAILURE_SQL}) group by concept, mode)"

_CHAIN = """select problem_id, concept, arm, rollout_idx, ok, cast(cast(gold as bigint) * 3 + 1000 as string) as ig,
  case when (problem_id + rollout_idx) % 3 = 0 then concat(response, ' from ', cast(cast(gold as bigint) * 3 + 1000 as string), '0') when (problem_id + rollout_idx) % 3 = 1 then concat(response, ' from ', cast(cast(gold as bigint) * 3 + 1000 as string), ' first') else response end as txt from @graded"""
_HIT = "select problem_id, concept, arm, rollout_idx, ok, {}(concat(' ', txt, ' '), concat('[^0-9.]', ig, '[^0-9.]')) as hit, length(ig) >= 3 as ig_reliable from ({}) c".format
_GAP = """select concept, arm, count(*) as n, count(*) filter (where hit) as n_hit, count(*) filter (where ok) as n_ok, count(*) filter (where hit and ok) as n_ok_hit, count(*) filter (where hit and not ok) as hit_but_fail,
  case when count(*) filter (where hit) > 0 then cast(count(*) filter (where hit and ok) as double) / count(*) filter (where hit) end as p_given_hit,
  case when count(*) filter (where not hit) > 0 then cast(count(*) filter (where ok and not hit) as double) / count(*) filter (where not hit) end as p_given_miss from ({}) h group by concept, arm""".format


# --- golds recomputed ------------------------------------------------------------------------------------------------

_MATH = """select row_id, concept, problem, cast(case when row_id % 11 = 0 then -1 else p_size end as bigint) as salt from (select p_partkey as row_id, p_size, case p_partkey % 7 when 0 then 'modular_exponent' when 1 then 'constrained_divisor_count' when 2 then 'divisor_sum_filter'
  when 3 then 'perfect_square_divisible' when 4 then 'multi_constraint_square' when 5 then 'triangular_filter_count' else 'inclusion_exclusion_3set' end as concept,
  case p_partkey % 7 when 0 then concat('Find the remainder of ', cast(p_partkey % 50 + 2 as string), ' to the power ', cast(p_size as string), ' modulo ', cast(p_partkey % 90 + 7 as string), '.')
  when 1 then concat('How many positive divisors of ', cast(p_partkey % 900 + 60 as string), ' are greater than ', cast(p_size as string), '?')
  when 2 then concat('Find the sum of the ', case when p_size % 2 = 0 then 'even' else 'odd' end, ' positive divisors of ', cast(p_partkey % 900 + 60 as string), '.')
  when 3 then concat('How many perfect squares below ', cast(p_partkey % 5000 + 100 as string), ' are divisible by ', cast(p_size % 12 + 2 as string), '?')
  when 4 then concat('How many perfect squares below ', cast(p_partkey % 5000 + 100 as string), ' are divisible by ', cast(p_size % 6 + 2 as string), ' and end in ', cast(p_partkey % 10 as string), '?')
  when 5 then concat('How many triangular numbers below ', cast(p_partkey % 5000 + 100 as string), ' are divisible by ', cast(p_size % 12 + 2 as string), '?')
  else concat('How many whole numbers up to ', cast(p_partkey % 900 + 60 as string), ' are divisible by ', cast(p_size % 5 + 2 as string), ', ', cast(p_size % 7 + 3 as string), ' or ', cast(p_size % 11 + 5 as string), '?') end as problem from @part) m"""


def _recompute(spark_side: bool) -> str:
    """SQL for one dialect: parse the numbers of each problem and count or sum over a bounded sequence."""
    if spark_side:
        nth = lambda k: f"try_cast(get(regexp_extract_all(problem, '[0-9]+', 0), {k - 1}) as bigint)"
        hits = lambda hi, cond: f"filter(sequence(1L, cast(greatest({hi}, 1) as bigint)), d -> {cond})"
        size, total = "cast(size({}) as bigint)".format, "aggregate({}, 0L, (s, x) -> s + x)".format
        power = "aggregate(sequence(1L, b), 1L, (s, x) -> s * a % c)"
    else:
        nth = lambda k: f"try_cast(regexp_extract_all(problem, '[0-9]+', 0)[{k}] as bigint)"
        hits = lambda hi, cond: f"list_filter(range(1, cast(greatest({hi}, 1) as bigint) + 1), lambda d: {cond})"
        size, total = "cast(len({}) as bigint)".format, "cast(coalesce(list_sum({}), 0) as bigint)".format
        power = "list_reduce(list_concat([1::bigint], range(1, b + 1)), lambda s, x: s * a % c)"
    return f"""select row_id, concept, recomputed, coalesce(case when salt < 0 then recomputed + 1 end, recomputed) as stored from (select row_id, concept, salt, case concept when 'modular_exponent' then {power}
  when 'constrained_divisor_count' then {size(hits('a', 'a % d = 0 and d > b'))}
  when 'divisor_sum_filter' then {total(hits('a', "a % d = 0 and (d % 2 = 1) = even_odd"))}
  when 'perfect_square_divisible' then {size(hits('floor(sqrt(a)) + 1', 'd * d < a and d * d % b = 0'))}
  when 'multi_constraint_square' then {size(hits('floor(sqrt(a)) + 1', 'd * d < a and d * d % b = 0 and d * d % 10 = c'))}
  when 'triangular_filter_count' then {size(hits('floor(sqrt(2 * a)) + 1', 'd * (d + 1) < 2 * a and (d * (d + 1)) % (2 * b) = 0'))}
  when 'inclusion_exclusion_3set' then {size(hits('a', 'd % b = 0 or d % c = 0 or d % e = 0'))} end as recomputed
  from (select row_id, concept, salt, problem like '% odd %' as even_odd, {nth(1)} as a, {nth(2)} as b, {nth(3)} as c, {nth(4)} as e from ({_MATH}) m) p) r"""


_REPORT = """select concept, count(*) as n, count(recomputed) as checked, count(*) filter (where recomputed is not null and stored <> recomputed) as bad,
  case when count(recomputed) = 0 then 'unchecked' when 2 * count(*) filter (where stored <> recomputed) > count(recomputed) then 'checker_suspect' when count(*) filter (where stored <> recomputed) > 0 then 'bad_golds' else 'ok' end as flag
  from ({}) r group by concept""".format
_GATE = "select concept, n, checked, bad, case when checked = 0 then false else bad = 0 end as ok from ({}) g".format
_VERDICT = "select count(*) as n_concepts, count(*) filter (where coalesce(ok, true)) as n_clean, bool_and(coalesce(ok, true)) as passed from ({}) v".format


# --- chains of concepts ----------------------------------------------------------------------------------------------

_COMPAT = """with a as (select concept, try_cast(answer as bigint) as v, count(*) as n from @pool group by concept, answer),
s as (select concept, min(knob_k) * 2 + length(concept) % 5 as lo, max(knob_k) * 3 + length(concept) % 5 as hi from @pool group by concept),
e as (select a.concept as source, s.concept as target, cast(sum(n) as bigint) as n, cast(sum(case when v between lo and hi then n else 0 end) as bigint) as n_in, count(distinct case when v between lo and hi then v end) as n_distinct
  from a join s on s.concept <> a.concept where v is not null group by a.concept, s.concept)
select source, target, n, n_in, n_distinct, round(cast(n_in as double) / n, 4) as frac, round(cast(n_in as double) / n, 4) >= 0.5 and n_distinct >= 5 as valid from e"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frame(spark, sf_dir, "pool")


_POOL_SQL = "select row_id, problem, answer, concept, knob_k from @pool"
_UNION = "select 'pool' as origin, row_id, problem, answer, cast(null as string) as reasoning from @pool union all select 'runs' as origin, idx as row_id, concept as problem, gold as answer, response as reasoning from @runs"
_PROMPT = "select conv_id, count(*) as n_messages, concat('system: Answer with a box.', chr(10), 'user: ', coalesce(min_by(text, turn) filter (where role = 'user'), '')) as prompt from @conversations group by conv_id"


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: views.query(spark, sf_dir, text)


def _documents(function: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: function(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _stream_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = files.scratch(spark, "rollouts")
    _rollouts(spark, sf_dir).write.parquet(source)
    return jobs.run(spark, jobs.grade_stream, source)


def _on_events(job) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: jobs.run(spark, job, f"{sf_dir}/events.parquet")


def _round_trip(form: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: files.round_trip(_pool(spark, sf_dir), form)


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "gold_extract": (gold_extract, _GOLD_SQL),
    "frac_normalize": (frac_normalize, _FRACTION_SQL),
    "format_reward": (format_reward, _FORMAT_SQL),
    "total_reward": (total_reward, _TOTAL_SQL),
    "grade_lenient": (grade_lenient, _lenient_sql()),
    "grade_legacy": (grade_legacy, _LEGACY_SQL),
    "grader_ablation": (grader_ablation, _ABLATION_SQL),
    "trigram_repetition": (_documents(trigram_repetition), _TRIGRAM_SQL),
    "repeated_lines": (_documents(repeated_lines), _LINES_SQL),
    "extract_numbers": (extract_numbers, _NUMBERS_SQL),
    "failure_modes": (failure_modes, _FAILURE_SQL),
    "failure_frac": (failure_frac, _FAILURE_FRAC_SQL),
    "intermediate_hit": (_sql(_HIT("regexp_like", _CHAIN)), _HIT("regexp_matches", _CHAIN)),
    "composition_gap": (_sql(_GAP(_HIT("regexp_like", _CHAIN))), _GAP(_HIT("regexp_matches", _CHAIN))),
    "recompute_counts": (_sql(_recompute(True)), _recompute(False)),
    "recompute_report": (_sql(_REPORT(_recompute(True))), _REPORT(_recompute(False))),
    "gate_golds": (_sql(_GATE(_REPORT(_recompute(True)))), _GATE(_REPORT(_recompute(False)))),
    "gate_verdict": (_sql(_VERDICT(_GATE(_REPORT(_recompute(True))))), _VERDICT(_GATE(_REPORT(_recompute(False))))),
    "chain_compat": (_sql(_COMPAT), _COMPAT),
    "pool_union": (_sql(_UNION), _UNION),
    "prompt_build": (_sql(_PROMPT), _PROMPT),
    "src_jsonl": (_round_trip("jsonl"), _POOL_SQL),
    "src_json_array": (_round_trip("json_array"), _POOL_SQL),
    "sink_roundtrip": (_round_trip("csv"), _POOL_SQL),
    "stream_grades": (_stream_grades, "select problem_id, arm, rollout_idx, pred, method, ok from @graded"),
    "stream_reward_log": (_on_events(jobs.running_log), "select cast(floor(event_id / 8) as bigint) as step, count(*) as n, count(*) filter (where value >= 100) as n_correct from @events group by floor(event_id / 8)"),
    "stream_daily": (_on_events(jobs.daily_health), """select cast(date_trunc('day', ts) as timestamp) as day, count(*) as n, count(*) filter (where value >= 100) as n_high from @events group by date_trunc('day', ts)
      having date_trunc('day', ts) + interval 1 day <= (select max(ts) from @events) - interval 1 hour"""),
}
