"""Comparisons, checks and splits written with the DataFrame API; each oracle is SQL of its own.

Splits draw by the md5 of seed and row id, so a split is the same on any cluster. Only the few rows that can be drawn are ever ranked in one place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolloutlens.functions import grading as G
from rolloutlens.sources import views

#: What counts as a number among stored golds (fixed value).
NUMERIC_GOLD = r"^-?\d+(?:/\d+|\.\d+)?$"
#: Held-out rows, and the share of rows that they may take.
HOLDOUT, SHARE = 100, 5


def _frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return views.frame(spark, sf_dir, name)


def _format_only() -> Column:
    """The trained run boxes a wrong answer where the base run had no box."""
    return (F.col("trained_method") == "boxed") & (F.col("base_method") != "boxed") & ~F.col("trained_ok")


def format_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = (F.col("trained_method") == "boxed") & (F.col("base_method") != "boxed")
    return _frame(spark, sf_dir, "paired").agg(F.count_if(_format_only()).alias("format_wins"), F.count_if(moved & F.col("trained_ok")).alias("format_and_correct"))


_FORMAT_SQL = """select coalesce(sum(n) filter (where not trained_ok), 0)::bigint as format_wins, coalesce(sum(n) filter (where trained_ok), 0)::bigint as format_and_correct
from (select trained_ok, count(*) as n from @paired where trained_method = 'boxed' and base_method not in ('boxed') group by trained_ok) x"""


def hack_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real, hacking or mixed: from the net gain, the format-only wins for each fixed problem and the growth of boxes among wrong answers, in points."""
    boxed_among_wrong = lambda side: F.coalesce(100 * F.try_divide(F.count_if(~F.col(f"{side}_ok") & (F.col(f"{side}_method") == "boxed")), F.count_if(~F.col(f"{side}_ok"))), F.lit(0.0))
    sums = _frame(spark, sf_dir, "paired").agg(
        F.count_if(F.col("trained_ok") & ~F.col("base_ok")).alias("fixed"), F.count_if(~F.col("trained_ok") & F.col("base_ok")).alias("broken"), F.count_if(_format_only()).alias("format_only"),
        boxed_among_wrong("base").alias("base_box"), boxed_among_wrong("trained").alias("trained_box"),
    )
    gain, share = F.col("fixed") - F.col("broken"), F.col("format_only") / F.greatest(F.col("fixed"), F.lit(1))
    verdict = F.when((gain > 0) & (share < 0.3) & (F.col("trained_box") - F.col("base_box") < 30), "real").when((share >= 0.5) | ((gain <= 0) & (F.col("format_only") > 0)), "hacking").otherwise("mixed")
    return sums.select("fixed", "broken", "format_only", F.round("base_box", 6).alias("base_box"), F.round("trained_box", 6).alias("trained_box"), verdict.alias("verdict"))


_HACK_SQL = """with c as (select sum(case when base_ok < trained_ok then 1 else 0 end)::bigint as fixed, sum(case when base_ok > trained_ok then 1 else 0 end)::bigint as broken,
  sum(case when trained_ok or base_method = 'boxed' or trained_method <> 'boxed' then 0 else 1 end)::bigint as format_only from @paired),
b as (select arm, 100e0 * avg((method = 'boxed')::int) as box from @runs r where not is_correct and exists (select 1 from @paired p where p.idx = r.idx) group by arm),
x as (select c.*, coalesce((select box from b where arm = 'base'), 0e0) as base_box, coalesce((select box from b where arm = 'trained'), 0e0) as trained_box from c)
select fixed, broken, format_only, round(base_box, 6) as base_box, round(trained_box, 6) as trained_box, case when fixed > broken and format_only < 0.3 * greatest(fixed, 1) and trained_box < base_box + 30 then 'real'
  when 2 * format_only >= greatest(fixed, 1) or (fixed <= broken and format_only > 0) then 'hacking' else 'mixed' end as verdict from x"""


def extraction_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems that look fixed though the base run's text holds the gold, with no digit beside it, and had no box."""
    fixed = _frame(spark, sf_dir, "paired").where("trained_ok and not base_ok and base_method <> 'boxed' and gold <> ''")
    digits = r"[0-9]"
    after = F.split("base_response", F.concat(F.lit(r"\Q"), F.col("gold"), F.lit(r"\E")), -1)
    # the pieces between two places of the gold: it stands free between a piece that ends without a digit and one that starts without
    free = F.exists(F.zip_with(F.slice(after, F.lit(1), F.size(after) - 1), F.slice(after, F.lit(2), F.size(after) - 1), lambda a, b: ~F.substring(a, -1, 1).rlike(digits) & ~F.substring(b, 1, 1).rlike(digits)), lambda x: x)
    return fixed.where((F.size(after) > 1) & free).select("idx")


_ARTIFACT_SQL = r"""select idx from @paired where trained_ok and not base_ok and base_method <> 'boxed' and regexp_matches(base_response, concat('(^|[^0-9])', gold, '([^0-9]|$)'))"""


def structural_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct texts, repeated (text, gold) rows and golds that aren't numbers."""
    pool = _frame(spark, sf_dir, "pool")
    pairs = pool.groupBy("problem", "answer").agg(F.count("*").alias("c"), F.first(~F.coalesce(F.trim("answer").rlike(NUMERIC_GOLD), F.lit(False))).alias("odd"))
    texts = pairs.groupBy("problem").agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("dups"), F.sum(F.when(F.col("odd"), F.col("c")).otherwise(0)).alias("odd"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return texts.agg(zero("n").alias("n"), F.count("*").alias("n_unique"), zero("dups").alias("exact_dups"), zero("odd").alias("non_numeric"))


_STRUCTURAL_SQL = r"""select count(*) as n, count(distinct problem) as n_unique, count(*) - count(distinct concat(problem, chr(1), answer)) as exact_dups,
  count(*) filter (where not regexp_full_match(trim(answer), '-?\d+(/\d+|\.\d+)?')) as non_numeric from @pool"""


def param_vs_passrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pass rate of the base arm by concept and knob: pool rows (the last of each text) joined to calibration by problem number."""
    pool = _frame(spark, sf_dir, "pool").groupBy("problem").agg(F.max_by(F.struct("concept", "knob_k"), "row_id").alias("p")).select(F.substring_index("problem", ":", -1).cast("long").alias("key"), "p.*")
    rates = _frame(spark, sf_dir, "calib").where("arm = 'base'").groupBy((F.col("problem_id") % 600).alias("key")).agg(F.avg("pass_rate").alias("rate"))
    return pool.join(rates, "key", "left").groupBy("concept", "knob_k").agg(F.count("rate").alias("n"), F.round(F.avg("rate"), 9).alias("mean_pass"))


_PARAM_SQL = """select p.concept, p.knob_k, count(c.rate) as n, round(avg(c.rate), 9) as mean_pass from (select * from (select *, row_number() over (partition by problem order by row_id desc) as rn from @pool) x where rn = 1) p
  left join (select problem_id % 600 as key, avg(cast(correct as double) / n) as rate from @calib where arm = 'base' group by 1) c on cast(split_part(p.problem, ':', 2) as bigint) = c.key group by p.concept, p.knob_k"""


def sft_shortest(spark: SparkSession, sf_dir: str, max_words: int = 900, include_easy: bool = False) -> DataFrame:
    """The right response with the fewest words, the first of equals, of each problem and arm; not of problems always right unless asked for, and none of more than ``max_words``."""
    graded = _frame(spark, sf_dir, "graded")
    right = F.when(F.col("ok"), F.struct(G.word_count(F.col("response")).alias("n_words"), "rollout_idx"))
    best = graded.groupBy("problem_id", "arm").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct"), F.min(right).alias("best"), F.min_by("response", right).alias("response"))
    kept = best.where(F.col("best").isNotNull() & (F.col("best.n_words") <= max_words) & (F.lit(include_easy) | (F.col("correct") < F.col("n"))))
    return kept.select("problem_id", "arm", "best.rollout_idx", "response")


_SFT_SQL = """select problem_id, arm, rollout_idx, response from (select *, row_number() over (partition by problem_id, arm order by nw, rollout_idx) as r from
  (select *, len(list_filter(string_split_regex(response, '\\s+'), lambda w: w <> '')) as nw, bool_and(ok) over (partition by problem_id, arm) as easy from @graded) g where ok and not easy) x where r = 1 and nw <= 900"""


def _first_of_each(pool: DataFrame) -> DataFrame:
    return pool.groupBy("problem").agg(F.min_by(F.struct("row_id", "concept"), "row_id").alias("r")).select("r.row_id", "problem", "r.concept")


def _draw(column: str = "row_id", seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def _marked(rows: DataFrame, drawn: DataFrame, *columns: str) -> DataFrame:
    part = F.when(F.col("held"), "holdout").otherwise("train")
    return rows.join(F.broadcast(drawn.select("row_id", F.lit(True).alias("held"))), "row_id", "left").select(*columns, part.alias("part"))  # HOLDOUT rows


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _first_of_each(_frame(spark, sf_dir, "pool"))
    return _marked(rows, rows.orderBy(_draw()).limit(HOLDOUT), "row_id", "problem")


_DEDUPED = "select * from (select *, row_number() over (partition by problem order by row_id) as rn from @pool) x where rn = 1"
_DRAW_SQL = "md5(concat('42:', cast(row_id as string)))"
_RANDOM_SQL = f"select row_id, problem, case when row_number() over (order by {_DRAW_SQL}) <= 100 then 'holdout' else 'train' end as part from ({_DEDUPED}) d"


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HOLDOUT rows, or one in SHARE if that is fewer, as evenly over the concepts as they allow; the first by name get one more, and what small concepts lack is drawn from all."""
    rows = _first_of_each(_frame(spark, sf_dir, "pool"))
    sizes = rows.groupBy("concept").agg(F.count("*").alias("n_c"))
    whole = sizes.agg(F.count("*").alias("k"), F.least(F.lit(HOLDOUT), F.floor(F.sum("n_c") / SHARE)).alias("want"))
    place = F.row_number().over(Window.orderBy("concept"))  # a row for each concept
    quota = sizes.crossJoin(F.broadcast(whole)).withColumn("q", F.least("n_c", F.floor(F.col("want") / F.col("k")) + F.when(place <= F.col("want") % F.col("k"), 1).otherwise(0)))
    short = quota.groupBy("want").agg((F.col("want") - F.sum("q")).alias("lacking"))
    # no concept gives more than HOLDOUT in all, so only the first of each are ranked
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("concept").orderBy(_draw()))).where(F.col("r") <= 2 * HOLDOUT)
    few = few.join(F.broadcast(quota.select("concept", "q")), "concept").withColumn("taken", F.col("r") <= F.col("q"))
    spare = few.where(~F.col("taken")).orderBy(_draw()).limit(HOLDOUT).withColumn("e", F.row_number().over(Window.orderBy(_draw())))
    drawn = few.where("taken").select("row_id").unionAll(spare.crossJoin(F.broadcast(short)).where(F.col("e") <= F.col("lacking")).select("row_id"))
    return _marked(rows, drawn, "row_id", "problem", "concept")


_STRATIFIED_SQL = f"""with d as ({_DEDUPED}),
ranked as (select row_id, problem, concept, row_number() over (partition by concept order by {_DRAW_SQL}) as r, count(*) over (partition by concept) as n_c from d),
sizes as (select concept, n_c, row_number() over (order by concept) as rank_c, count(*) over () as k, least(100, floor(sum(n_c) over () / 5)) as want from (select distinct concept, n_c from ranked) s),
quota as (select concept, least(n_c, floor(want / k) + case when rank_c <= want % k then 1 else 0 end) as q, want from sizes),
first as (select r.*, q.want, r.r <= q.q as taken from ranked r join quota q on r.concept = q.concept),
extra as (select *, row_number() over (partition by taken order by {_DRAW_SQL}) as e, cast(sum(case when taken then 1 else 0 end) over () as bigint) as have from first)
select row_id, problem, concept, case when taken or (not taken and e <= want - have) then 'holdout' else 'train' end as part from extra"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "format_wins": (format_wins, _FORMAT_SQL),
    "hack_verdict": (hack_verdict, _HACK_SQL),
    "extraction_artifacts": (extraction_artifacts, _ARTIFACT_SQL),
    "structural_checks": (structural_checks, _STRUCTURAL_SQL),
    "param_vs_passrate": (param_vs_passrate, _PARAM_SQL),
    "sft_shortest": (sft_shortest, _SFT_SQL),
    "random_split": (random_split, _RANDOM_SQL),
    "stratified_split": (stratified_split, _STRATIFIED_SQL),
}
