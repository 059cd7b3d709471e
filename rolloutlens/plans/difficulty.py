"""Difficulty by count of right rollouts, kinds of failure with worked solutions, golds that conflict; each oracle is SQL of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlens.functions import failures
from rolloutlens.sources import views

#: The sweet spot by rollouts of a problem: from, to.
SWEET = {8: (2, 6), 16: (2, 12)}


def band(correct: Column, low: int, high: int) -> Column:
    """hard below the sweet spot, easy above it."""
    return F.when(correct < low, "hard").when(correct <= high, "sweet").otherwise("easy")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(problem_id, arm, correct, n, k, band): by arm as of 8 rollouts, and both arms together (``both``) as of 16."""
    calib = views.frame(spark, sf_dir, "calib").select("problem_id", "arm", "correct", "n")
    both = calib.groupBy("problem_id").agg(F.sum("correct").alias("correct"), F.sum("n").alias("n")).select("problem_id", F.lit("both").alias("arm"), "correct", "n")
    banded = lambda rows, k: rows.withColumn("k", F.lit(k)).withColumn("band", band(F.col("correct"), *SWEET[k]))
    return banded(calib, 8).union(banded(both, 16))


_COUNTED = """select *, case when correct < 2 then 'hard' when correct > case k when 8 then 6 else 12 end then 'easy' else 'sweet' end as band from (select problem_id, arm, correct, n, 8 as k from @calib
  union all select problem_id, 'both', sum(correct)::bigint, sum(n)::bigint, 16 from @calib group by problem_id) c"""


def sweet_spot_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir).select("problem_id", "arm", "correct", "band")


def difficulty_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By arm a row for each count from 0 to k, also where no problem has it: problems, their percent, and how many problems of the arm are hard, sweet and easy."""
    rows = counted(spark, sf_dir)
    arms = rows.groupBy("arm", "k").agg(F.count("*").alias("total"), *[F.count_if(F.col("band") == b).alias(f"n_{b}") for b in ("hard", "sweet", "easy")])
    every = arms.withColumn("correct", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long"))))
    have = rows.groupBy("arm", "correct").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return every.join(have, ["arm", "correct"], "left").select("arm", "correct", n.alias("n"), F.round(100.0 * n / F.col("total"), 6).alias("percent"), "n_hard", "n_sweet", "n_easy")


_DIST_SQL = f"""with c as materialized ({_COUNTED}), e as (select arm, unnest(range(0, any_value(k) + 1))::bigint as correct, count(*) as total, count(*) filter (where band = 'hard') as n_hard, count(*) filter (where band = 'sweet') as n_sweet, count(*) filter (where band = 'easy') as n_easy from c group by arm)
select e.arm, e.correct, count(c.arm) as n, round(100e0 * count(c.arm) / any_value(total), 6) as percent, any_value(n_hard) as n_hard, any_value(n_sweet) as n_sweet, any_value(n_easy) as n_easy from e left join c on c.arm = e.arm and c.correct = e.correct group by e.arm, e.correct"""


def ghost_batch(spark: SparkSession, sf_dir: str, batch: int = 8) -> DataFrame:
    """By arm and group of problems - a band, ``all`` (no filter) or ``filtered`` (the sweet spot kept) -: problems, the mean chance that a batch is all right or all wrong, and for
    ``filtered`` by how many percent that is below ``all`` (null without a sweet spot, or where nothing can be saved).
    """
    p = F.col("correct") / F.col("n")
    rows = counted(spark, sf_dir).select("arm", "band", (F.pow(p, batch) + F.pow(1 - p, batch)).alias("ghost"))
    groups = rows.groupBy("arm", "band").agg(F.count("*").alias("n"), F.sum("ghost").alias("s"))
    all_ = groups.groupBy("arm").agg(F.lit("all").alias("band"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    sweet = groups.where("band = 'sweet'").select("arm", F.lit("filtered").alias("band"), "n", "s")
    saved = all_.select("arm", (F.col("s") / F.col("n")).alias("m"))
    less = F.when((F.col("band") == "filtered") & (F.col("m") > 0), F.round(100 * (F.col("m") - F.col("s") / F.col("n")) / F.col("m"), 6))
    return groups.union(all_).union(sweet).join(F.broadcast(saved), "arm").select("arm", F.col("band").alias("strategy"), "n", F.round(F.col("s") / F.col("n"), 9).alias("ghost_probability"), less.alias("percent_less"))  # a row for each arm


_GHOST_SQL = f"""with g as materialized (select arm, band, pow(correct::double / n, 8) + pow(1 - correct::double / n, 8) as p from ({_COUNTED}) c), a as (select arm, avg(p) as m from g group by arm)
select arm, band as strategy, count(*) as n, round(avg(p), 9) as ghost_probability, null::double as percent_less from g group by arm, band union all select arm, 'all', count(*), round(avg(p), 9), null from g group by arm
union all select g.arm, 'filtered', count(*), round(avg(p), 9), case when any_value(m) > 0 then round(100 * (any_value(m) - avg(p)) / any_value(m), 6) end from g join a on a.arm = g.arm where band = 'sweet' group by g.arm"""


#: Wrong answers that go on in several ways, a question and a worked solution, from the gold.
_TALES = """select problem_id, arm, concept, method, rightly, concat('Take ', cast(g + 50 as string), ' and 20.') as question,
  case when problem_id % 11 = 0 then '' else concat('First ', cast(g as string), '*3=', cast(g * 3 as string), ', then ', cast(g * 3 as string), '+1000=', cast(g * 3 + 1000 as string), '. #### ', cast(g as string)) end as gold_text,
  concat(wrong, case problem_id % 7 when 1 then concat(chr(10), 'The same long line here ', chr(9), chr(10), '  the same', chr(10), 'The same long line here', chr(10), 'The same long line here') when 2 then concat(' since ', cast(g * 3 as string), ' plus 1,000 is ', cast(g * 3 + 1000 as string))
    when 3 then ' with 777 and 888.5 and 9' when 4 then ' Go on and go on and GO ON AND go on and go on and' when 5 then concat(' of ', cast(g + 50 as string), ' from 20 and 777') else '' end) as wrong from ({}) w""".format
_PAIRS = """select problem_id, arm, concept, cast(min(gold) as bigint) as g, min_by(method, case when not ok then rollout_idx end) as method, min_by(response, case when not ok then rollout_idx end) as wrong, min_by(response, case when ok then rollout_idx end) as rightly
  from @graded group by problem_id, arm, concept having count(case when not ok then 1 end) > 0"""


def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of failure where a question and a worked solution are known (one in eleven solutions is empty)."""
    rows = views.query(spark, sf_dir, _TALES(_PAIRS))
    return rows.select("problem_id", "arm", "concept", failures.kind(F.col("method"), F.col("wrong"), F.col("rightly"), F.col("question"), F.col("gold_text")).alias("mode"))


_DUCK_PAIRS = """select problem_id, arm, concept, cast(min(gold) as bigint) as g, arg_min(method, rollout_idx) filter (where not ok) as method, arg_min(response, rollout_idx) filter (where not ok) as wrong, arg_min(response, rollout_idx) filter (where ok) as rightly
  from @graded group by problem_id, arm, concept having count(*) filter (where not ok) > 0"""


def conflicting_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with two golds or more, all of them in order (a null gold as null)."""
    golds = F.array_sort(F.collect_set(F.coalesce("answer", F.lit("null"))))
    return views.frame(spark, sf_dir, "pool").groupBy("problem").agg(golds.alias("g")).where(F.size("g") > 1).select("problem", F.size("g").cast("long").alias("n_golds"), F.concat_ws(", ", "g").alias("golds"))


_CONFLICT_SQL = "select problem, count(distinct coalesce(answer, 'null')) as n_golds, array_to_string(list_sort(list_distinct(list(coalesce(answer, 'null')))), ', ') as golds from @pool group by problem having count(distinct coalesce(answer, 'null')) > 1"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "sweet_spot_bands": (sweet_spot_bands, f"select problem_id, arm, correct, band from ({_COUNTED}) c"),
    "difficulty_dist": (difficulty_dist, _DIST_SQL),
    "ghost_batch": (ghost_batch, _GHOST_SQL),
    "failure_kinds": (failure_kinds, failures.kind_sql(_TALES(_DUCK_PAIRS))),
    "conflicting_golds": (conflicting_golds, _CONFLICT_SQL),
}
