"""The calibration report in full, for both arms, and pass rates by knob value; the oracles are SQL of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlens.functions import failures
from rolloutlens.operators import calibration as C
from rolloutlens.sources import views

#: Pool rows of the first problem of each part: knobs for four in five, a second version of one in seven with another size.
_POOL = """select p_partkey * 2 + v as row_id, concat('Problem ', cast(p_partkey as string)) as problem, p_partkey % 5 <> 0 as stamped, cast(p_size % 5 + v as string) as size, concat('"s', cast(p_partkey % 3 as string), '"') as step,
  case when p_partkey % 2 = 1 then 'true' else 'false' end as odd from @part join (select 0 as v union all select 1) w on v = 0 or p_partkey % 7 = 0"""
_MADE = "select p_type as concept, cast(count(case when p_size > 10 then 1 end) as double) / count(*) as survival from @part where length(p_type) % 3 <> 0 group by p_type"


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frame(spark, sf_dir, "graded").withColumn("problem", F.concat(F.lit("Problem "), F.col("problem_id")))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    knobs = F.when(F.col("stamped"), F.create_map(F.lit("size"), "size", F.lit("step"), "step", F.lit("odd"), "odd"))
    return views.query(spark, sf_dir, _POOL).select("row_id", "problem", knobs.alias("knobs"))


def param_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rates by arm, concept, knob and JSON value."""
    return C.knob_rates(C.by_problem(_graded(spark, sf_dir)), _pool(spark, sf_dir))


_LAST = f"select problem, unnest(['size', 'step', 'odd']) as param, unnest([size, step, odd]) as value from (select * from ({_POOL}) p qualify row_number() over (partition by problem order by row_id desc) = 1) q where stamped"
_PARAM_SQL = f"""select arm, concept, param, value, count(*) as n, round(avg(pass_rate), 4) as pass_rate from @calib c join ({_LAST}) p on p.problem = concat('Problem ', c.problem_id) group by arm, concept, param, value"""


def calib_report_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as text, - for none."""
    done = C.report(_graded(spark, sf_dir), _pool(spark, sf_dir), views.query(spark, sf_dir, _MADE))
    params = F.concat_ws("; ", F.transform("params", lambda x: F.concat(x["param"], F.lit("="), x["value"], F.lit(" "), x["n"])))
    texts = {"hist": F.concat_ws(",", F.transform("hist", lambda x: x.cast("string"))), "params": F.when(F.col("params").isNotNull(), params).otherwise("-"), "concept": F.coalesce("concept", F.lit("-"))}
    return done.withColumns(texts)


_KINDS = failures.kind_sql("""select problem_id, arm, concept, arg_min(method, rollout_idx) filter (where not ok) as method, arg_min(response, rollout_idx) filter (where not ok) as wrong, arg_min(response, rollout_idx) filter (where ok) as rightly,
  '' as question, '' as gold_text from @graded group by problem_id, arm, concept having count(*) filter (where not ok) > 0""")
_REPORT_SQL = f"""with p as materialized (select c.*, m.mode, x.cut, x.gold from @calib c join (select problem_id, arm, min(gold) as gold, count(*) filter (where response not like '%\\boxed%') as cut from @graded group by 1, 2) x on x.problem_id = c.problem_id and x.arm = c.arm
  left join ({_KINDS}) m on m.problem_id = c.problem_id and m.arm = c.arm and m.concept = c.concept),
s as (select arm, concept, count(*) as n, {', '.join(f"round(avg((zone = '{z}')::int), 4) as {z}" for z in C.ZONES)}, concat_ws(',', {', '.join(f"count(*) filter (where correct = {k})" for k in range(9))}) as hist, round(avg(pass_rate), 4) as mean_pass,
  round(sum(cut)::double / sum(n), 4) as truncation, round(avg((correct = 0 or correct = n)::int), 4) as ghost_frac, count(mode) as n_classified, {', '.join(f"round(avg((mode = '{k}')::int), 4) as {k}" for k in C.KINDS)} from p group by grouping sets ((arm, concept), (arm))),
g as (select arm, concept, gold, count(*) as c from p group by all), t as (select arm, concept, round(list_sum(list_sort(list(c), 'desc')[1:3])::double / sum(c), 4) as top3 from g group by 1, 2),
e as (select arm, concept, round(-sum(c::double / n * log2(c::double / n)), 4) as entropy from (select *, sum(c) over (partition by arm, concept) as n from g) h group by 1, 2),
k as (select arm, concept, string_agg(concat(param, '=', value, ' ', n), '; ' order by param, value) as params from ({_PARAM_SQL}) q group by 1, 2)
select s.arm, coalesce(s.concept, '-') as concept, s.n, {', '.join('s.' + z for z in C.ZONES)}, s.hist, s.mean_pass, s.truncation, s.ghost_frac, s.n_classified, {', '.join('s.' + x for x in C.KINDS)}, t.top3, e.entropy, round(m.survival, 4) as survival, coalesce(k.params, '-') as params
from s left join t on t.arm = s.arm and t.concept = s.concept left join e on e.arm = s.arm and e.concept = s.concept left join ({_MADE}) m on m.concept = s.concept left join k on k.arm = s.arm and k.concept = s.concept"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "param_values": (param_values, _PARAM_SQL),
    "calib_report_full": (calib_report_full, _REPORT_SQL),
}
