"""The calibration report from graded rollouts, a problem pool with knob maps and the sidecar of its making."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloutlens.functions import failures
from rolloutlens.functions.grading import zone

ZONES = ("too_hard", "borderline", "goldilocks", "too_easy")
KINDS = ("format_failure", "early_termination", "repetition_loop", "calculation_error")


def by_problem(graded: DataFrame) -> DataFrame:
    """A row for each problem and arm of ``graded`` (problem, arm, concept, gold, rollout_idx, response, method, ok): n, correct, cut (answers without a box), pass_rate, zone, and the kind of
    the first wrong answer's failure (null if all are right).
    """
    ok, at = F.col("ok"), F.col("rollout_idx")
    rows = graded.groupBy("problem", "arm", "concept").agg(
        F.min("gold").alias("gold"), F.count("*").alias("n"), F.count_if("ok").alias("correct"), F.count_if(~F.contains("response", F.lit("\\boxed"))).alias("cut"),
        F.min_by(F.when(~ok, F.struct("response", "method")), F.when(~ok, at)).alias("wrong"), F.min_by(F.when(ok, F.col("response")), F.when(ok, at)).alias("right"),
    )
    kind = F.when(F.col("wrong").isNotNull(), failures.kind(F.col("wrong.method"), F.col("wrong.response"), F.col("right")))
    return rows.select("problem", "arm", "concept", "gold", "n", "correct", "cut", (F.col("correct") / F.col("n")).alias("pass_rate"), zone(F.col("correct"), F.col("n")).alias("zone"), kind.alias("kind"))


def knob_rates(problems: DataFrame, pool: DataFrame) -> DataFrame:
    """(arm, concept, param, value, n, pass_rate): the mean pass rate of the problems whose pool row has a knob at a value.

    ``pool`` has (row_id, problem, knobs), knobs a map from names to JSON values; of rows with one text the last counts; a null map has no knobs, a null value is 'null'.
    """
    last = pool.groupBy("problem").agg(F.max_by("knobs", "row_id").alias("knobs")).where("knobs is not null")
    pairs = problems.join(last, "problem").select("arm", "concept", "pass_rate", F.explode("knobs").alias("param", "value"))
    return pairs.groupBy("arm", "concept", "param", F.coalesce("value", F.lit("null")).alias("value")).agg(F.count("*").alias("n"), F.round(F.avg("pass_rate"), 4).alias("pass_rate"))


def golds_spread(problems: DataFrame) -> DataFrame:
    """(arm, concept, top3, entropy): the share of the three commonest golds and the entropy of all, in bits."""
    counts = problems.groupBy("arm", "concept", "gold").agg(F.count("*").alias("c"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("arm", "concept").orderBy(F.desc("c"), "gold")))
    n = F.sum("c")
    return ranked.groupBy("arm", "concept").agg((F.sum(F.when(F.col("r") <= 3, F.col("c"))) / n).alias("top3"), (F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n).alias("entropy"))


def report(graded: DataFrame, pool: DataFrame | None = None, made: DataFrame | None = None, k: int = 8) -> DataFrame:
    """By arm and concept, and by arm over all concepts (a null concept): problems, zone shares, problems by right answers (0 to ``k``, a list), mean pass rate, truncation, ghost share,
    problems with a classified failure and the shares of its kinds; by concept also top-3 share and entropy of golds, survival of the pool (``made``: concept, survival) and the knob rates
    (a list of param, value, n, pass_rate in order). What can't be known (no pool, no sidecar, no knobs, no failure) is null.
    """
    problems = by_problem(graded)
    share = lambda condition: F.round(F.count_if(condition) / F.count("*"), 4)
    failed = F.count("kind")

    def of_failed(kind: str) -> Column:
        return F.round(F.try_divide(F.count_if(F.col("kind") == kind).cast("double"), failed), 4)

    sums = problems.groupingSets([[F.col("arm"), F.col("concept")], [F.col("arm")]], F.col("arm"), F.col("concept")).agg(
        F.grouping("concept").alias("whole"), F.count("*").alias("n"), *[share(F.col("zone") == z).alias(z) for z in ZONES], F.array(*[F.count_if(F.col("correct") == c) for c in range(k + 1)]).alias("hist"),
        F.round(F.avg("pass_rate"), 4).alias("mean_pass"), F.round(F.sum("cut") / F.sum("n"), 4).alias("truncation"), share((F.col("correct") == 0) | (F.col("correct") == F.col("n"))).alias("ghost_frac"),
        failed.alias("n_classified"), *[of_failed(x).alias(x) for x in KINDS],
    )
    spread = golds_spread(problems).select("arm", "concept", F.lit(0).alias("whole"), F.round("top3", 4).alias("top3"), F.round("entropy", 4).alias("entropy"))
    out = _beside(sums, spread, ["arm", "concept", "whole"])
    if made is None:
        out = out.withColumn("survival", F.lit(None).cast("double"))
    else:
        out = _beside(out, made.groupBy("concept").agg(F.round(F.max("survival"), 4).alias("survival")).withColumn("whole", F.lit(0)), ["concept", "whole"])
    kind = "array<struct<param: string, value: string, n: bigint, pass_rate: double>>"
    if pool is None:
        out = out.withColumn("params", F.lit(None).cast(kind))
    else:
        rates = knob_rates(problems, pool).groupBy("arm", "concept").agg(F.sort_array(F.collect_list(F.struct("param", "value", "n", "pass_rate"))).alias("params"))  # values of knobs are few
        out = _beside(out, rates.withColumn("whole", F.lit(0)), ["arm", "concept", "whole"])
    return out.drop("whole")


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which nulls are equal, with the left side's keys."""
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in keys})
    same = None
    for c in keys:
        test = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = test if same is None else same & test
    return left.join(renamed, same, "left").drop(*[f"_{c}" for c in keys])
