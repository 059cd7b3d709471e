"""Reports along a training run: calibration and health as streams, the trailing reward log by run, parsed and right answers by step.

The streams' sources are rollouts that say how many rows their group has, as a sampler and a trainer know; the oracles work on the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlens.functions import grading
from rolloutlens.sources import files, views
from rolloutlens.streaming import jobs

#: Rows of the trailing log, and the steps between dumps.
TAIL, DUMP_EVERY = 500, 50

_STEP = "cast(floor(problem_id % 10000000000 / 2) as bigint)"
#: Rollouts of a training step: two parts' problems of an arm; ``at`` numbers the step's rows.
_STEPPED = f"""select arm as run, step, n_tokens, response, gold, row_number() over (partition by arm, step order by problem_id, rollout_idx) - 1 as at, count(*) over (partition by arm, step) as n_step
from (select *, {_STEP} as step from @rollouts) r"""
#: A log by run: eight answers a step, from step 1 on.
_LOG = "select event_type as run, event_id as seq, cast(floor((row_number() over (partition by event_type order by event_id) - 1) / 8) as bigint) + 1 as step, case when value >= 100 then 1e0 else 0e0 end as reward from @events"


def _streamed(rows: DataFrame, job: Callable[[SparkSession, str, str, str], None], n_files: int = 12) -> DataFrame:
    source = files.scratch(rows.sparkSession, "rollouts")
    rows.repartition(n_files).write.parquet(source)
    return jobs.run(rows.sparkSession, job, source)


def counted_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts with the number that their problem has."""
    return views.query(spark, sf_dir, "select *, count(*) over (partition by problem_id, arm) as n_rollouts from @rollouts")


def stepped_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts with run, step, their number in the step, the step's rows and the run's last step."""
    rows = views.query(spark, sf_dir, _STEPPED)
    return rows.join(F.broadcast(rows.groupBy("run").agg(F.max("step").alias("last_step"))), "run")  # a row for each arm


def stream_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(counted_rollouts(spark, sf_dir), jobs.calibrate_stream)


def stream_health(spark: SparkSession, sf_dir: str, every: int = 50) -> DataFrame:
    got = _streamed(stepped_rollouts(spark, sf_dir), jobs.health_stream(every))
    return got.select("run", "step", "n", *[F.round(c, 9).alias(c) for c in ("pass_rate", "boxed_rate", "mean_tokens")])


_HEALTH_SQL = f"""select run, step, n, pass_rate, boxed_rate, mean_tokens from (select *, max(step) over (partition by run) as last_step from (select arm as run, {_STEP} as step, count(*) as n, round(avg(ok::int), 9) as pass_rate,
  round(avg((method = 'boxed')::int), 9) as boxed_rate, round(avg(n_tokens), 9) as mean_tokens from @graded group by 1, 2) s) t where step % 50 = 0 or step = last_step"""


def trailing_dumps(log: DataFrame, tail: int = TAIL, every: int = DUMP_EVERY) -> DataFrame:
    """(run, dump_step, pos, step, seq, reward): at each ``every``-th step of a run its last ``tail`` log rows, the oldest first.

    ``log`` has (run, step, seq, reward), seq in the order of writing. Only step counts are put in order over a whole run; rows are numbered within their step. A step meets the dumps that
    can hold it by the number of rows before them, in cells of ``tail`` rows.
    """
    from pyspark.sql import Window

    steps = log.groupBy("run", "step").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("run").orderBy("step")) - F.col("k")
    steps = steps.withColumn("before", before).withColumn("upto", F.col("before") + F.col("k"))
    cell = lambda c: F.expr(f"{c} div {tail}")
    dumps = steps.where(F.col("step") % every == 0).select("run", F.col("step").alias("dump_step"), F.col("upto").alias("total"), cell("upto").alias("cell"))
    # a step's rows are in dumps with a total from its own first row on to ``tail`` rows beyond its last
    cells = F.sequence(cell("before"), F.expr(f"(upto + {tail}) div {tail}"))
    held = steps.withColumn("cell", F.explode(cells)).join(dumps, ["run", "cell"]).where("dump_step >= step and total - upto < %d" % tail)
    numbered = log.withColumn("r", F.row_number().over(Window.partitionBy("run", "step").orderBy("seq")))
    rows = numbered.join(held.select("run", "step", "dump_step", "total", "before"), ["run", "step"])
    pos = F.col("before") + F.col("r") - F.greatest(F.col("total") - tail, F.lit(0))
    return rows.withColumn("pos", pos).where("pos >= 1").select("run", "dump_step", "pos", "step", "seq", "reward")


def reward_log_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing_dumps(views.query(spark, sf_dir, _LOG))


_DUMPS_SQL = f"""with l as materialized ({_LOG}), d as (select run, step as dump_step, max(seq) as upto from l where step % 50 = 0 group by run, step)
select run, dump_step, row_number() over (partition by run, dump_step order by seq) as pos, step, seq, reward from (select d.run, dump_step, step, seq, reward, row_number() over (partition by d.run, dump_step order by seq desc) as b
from d join l on l.run = d.run and l.seq <= d.upto) x where b <= 500"""


def reward_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By run and step: answers, those that could be read, the right ones."""
    graded = grading.grade(stepped_rollouts(spark, sf_dir))
    return graded.groupBy("run", "step").agg(F.count("*").alias("n"), F.count("pred").alias("n_parsed"), F.count_if("ok").alias("n_correct"))


_STEPS_SQL = f"select arm as run, {_STEP} as step, count(*) as n, count(*) filter (where method <> 'no_answer') as n_parsed, count(*) filter (where ok) as n_correct from @graded group by 1, 2"

def chat_prompt(question: Column, system: str) -> Column:
    """A prompt as messages: array<struct<role, content>>, the system's first; a null question is empty."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", F.coalesce(question, F.lit(""))))


def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of all conversations, from their first user turn, a row for each message."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    user = F.col("role") == "user"
    firsts = talks.groupBy("conv_id").agg(F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("q"))
    return firsts.select("conv_id", F.posexplode(chat_prompt(F.col("q"), "Answer with a box.")).alias("pos", "m")).select("conv_id", F.col("pos").cast("long").alias("pos"), "m.role", "m.content")


_MESSAGES_SQL = """with q as (select conv_id, coalesce(arg_min(text, turn) filter (where role = 'user'), '') as q from @conversations group by conv_id)
select conv_id, 0::bigint as pos, 'system' as role, 'Answer with a box.' as content from q union all select conv_id, 1, 'user', q from q"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "stream_calibration": (stream_calibration, "select problem_id, arm, concept, n, correct, pass_rate, zone from @calib"),
    "stream_health": (stream_health, _HEALTH_SQL),
    "reward_log_dumps": (reward_log_dumps, _DUMPS_SQL),
    "reward_steps": (reward_steps, _STEPS_SQL),
    "prompt_messages": (prompt_messages, _MESSAGES_SQL),
}
