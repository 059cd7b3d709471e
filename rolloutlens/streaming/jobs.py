"""Structured Streaming jobs over the same operators. Each reads files as a stream until all that is there is done, and can be started again on its checkpoint.

What has been seen is kept in Spark's state store, so no job reads its own output.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rolloutlens.functions import grading
from rolloutlens.sources.files import scratch

#: Bytes of files that a micro-batch takes, one file at least: batches by the number of files would be as many as a table has small files, each with a commit of every part of the state.
BATCH_BYTES = 1 << 29
#: Where states are kept: on the executors' disks, with a bound for what an executor has of them in memory. What a session sets itself goes first, and a checkpoint goes on as it began.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
}
#: How long after its latest row a timed group stays in the state: it waits for its last rows, or knows late repeats.
KEEP_MS = 24 * 3600 * 1000
#: Parts of a stream's groups that Python is called for; a checkpoint goes on with the number it began with.
BUCKETS = 1024


def _stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(path)


def _to_files(stream: DataFrame, output: str, checkpoint: str) -> None:
    conf = stream.sparkSession.conf
    own = [k for k in STATE if conf.get(k, None) is None]
    for k in own:
        conf.set(k, STATE[k])
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:  # a query keeps the settings that it began with
        for k in own:
            conf.unset(k)
    query.awaitTermination()


def grade_stream(spark: SparkSession, rollouts: str, output: str, checkpoint: str) -> None:
    """Grade each rollout once and append it: keys that came before are known by the state, also after a restart, and the file sink takes a batch whole or not at all."""
    keys = ["problem_id", "arm", "rollout_idx"]
    graded = grading.grade(_stream(spark, rollouts).dropDuplicates(keys)).select(*keys, "pred", "method", "ok")
    _to_files(graded, output, checkpoint)


def complete_groups(stream: DataFrame, keys: list[str], index: str, expected: str, sums: dict[str, Column], time: str | None = None, keep_ms: int = KEEP_MS) -> DataFrame:
    """A row for each group of a stream, told once, when its last row comes: keys, n and the sums of ``sums``, and complete.

    ``expected`` says how many rows a group has, ``index`` (from 0) which one a row is; rows that come again are left out. A group's state is its bits and sums; the states of many groups, dealt
    by hash into BUCKETS, are one state of Spark's, so Python is called for each bucket and batch, not for each group. Null keys make a group; rows without an index or a count are left out.
    With ``time`` (an event time that has a watermark) a group is dropped ``keep_ms`` after its latest row, and one that isn't full by then is told as it stands, with complete false; without
    it, states stay.
    """
    kinds = dict(stream.dtypes)
    when = F.unix_millis(F.col(time)).alias("_t") if time else F.lit(0).cast("long").alias("_t")
    # pandas makes whole numbers with a null among them floats, so nulls of such keys travel apart
    whole = [k for k in keys if kinds[k] in ("tinyint", "smallint", "int", "bigint")]
    sent = [F.coalesce(F.col(k), F.lit(0).cast(kinds[k])).alias(f"_k{n}") if k in whole else F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]
    nulls = [F.col(k).isNull().alias(f"_null{n}") if k in whole else F.lit(False).alias(f"_null{n}") for n, k in enumerate(keys)]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("_bucket")
    rows = stream.where((F.col(index) >= 0) & F.col(expected).isNotNull()).select(
        bucket, *sent, *nulls, *([time] if time else []), F.col(index).cast("long").alias("_i"), F.col(expected).cast("long").alias("_of"), when, *[c.cast("double").alias(f"_s{n}") for n, c in enumerate(sums.values())]
    )
    columns, timed = [*keys, "n", *sums, "complete"], time is not None
    key_names, null_names, sum_names = ([f"_{x}{n}" for n in range(len(of))] for x, of in (("k", keys), ("null", keys), ("s", sums)))

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # by key: the rows seen as bits (groups may have more rows than a number has), told, the latest time, the sums, when it is dropped
        groups: dict[tuple, list] = pickle.loads(state.get[0]) if state.exists else {}
        wanted: dict[tuple, int] = {}
        told: list[list] = []

        def tell(key: tuple, complete: bool) -> None:
            told.append([*key, groups[key][0].bit_count(), *groups[key][3], complete])

        for batch in batches if not state.hasTimedOut else ():
            each = lambda names: zip(*(batch[c].tolist() for c in names), strict=True) if names else ((),) * len(batch)
            for values, missing, (i, of, at), numbers in zip(each(key_names), each(null_names), each(["_i", "_of", "_t"]), each(sum_names), strict=True):
                key = tuple(None if m else v for v, m in zip(values, missing, strict=True)) if any(missing) else values
                group = groups.get(key)
                if group is None:
                    group = groups[key] = [0, False, 0, [0.0] * len(sum_names), 0]
                wanted[key], group[2] = max(wanted.get(key, 0), of), max(group[2], at)
                if not group[0] >> i & 1:
                    group[0] |= 1 << i
                    group[3] = [t + (0.0 if v != v else v) for t, v in zip(group[3], numbers, strict=True)]
        watermark = state.getCurrentWatermarkMs() if timed else 0
        for key, of in wanted.items():
            group = groups[key]
            if not group[1] and group[0].bit_count() >= of:
                group[1] = True
                tell(key, True)
            group[4] = max(group[2], watermark) + keep_ms
        if timed:
            for key in [k for k, g in groups.items() if k not in wanted and g[4] < watermark]:
                if not groups[key][1]:
                    tell(key, False)
                del groups[key]
        if groups:
            state.update((pickle.dumps(groups, 5),))
            if timed:
                state.setTimeoutTimestamp(max(min(g[4] for g in groups.values()), watermark + 1))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame({c: pd.Series([r[n] for r in told], dtype=object) for n, c in enumerate(columns)})

    out = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["n long"] + [f"{k} double" for k in sums] + ["complete boolean"])
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return rows.groupBy("_bucket").applyInPandasWithState(step, out, "groups binary", "append", timeout)


def calibrate_stream(spark: SparkSession, rollouts: str, output: str, checkpoint: str) -> None:
    """(problem_id, arm, concept, n, correct, pass_rate, zone) of a problem, appended when its last rollout (of ``n_rollouts``) has come."""
    graded = grading.grade(_stream(spark, rollouts))
    groups = complete_groups(graded, ["problem_id", "arm", "concept"], "rollout_idx", "n_rollouts", {"correct": F.col("ok").cast("int")}).where("complete")
    correct = F.col("correct").cast("long")
    _to_files(groups.select("problem_id", "arm", "concept", "n", correct.alias("correct"), (F.col("correct") / F.col("n")).alias("pass_rate"), grading.zone(correct, F.col("n")).alias("zone")), output, checkpoint)


def cadence(step: Column, last: Column, every: int) -> Column:
    """Whether a step is looked at: the first (0), every ``every``-th and the last."""
    return (step % every == 0) | (step == last)


def health_stream(every: int = 50) -> Callable[[SparkSession, str, str, str], None]:
    """A job: (run, step, n, pass_rate, boxed_rate, mean_tokens) of the steps on the ``cadence``, each appended when all its rollouts have come; other steps don't reach the state."""

    def job(spark: SparkSession, rollouts: str, output: str, checkpoint: str) -> None:
        chosen = grading.grade(_stream(spark, rollouts).where(cadence(F.col("step"), F.col("last_step"), every)))
        sums = {"correct": F.col("ok").cast("int"), "boxed": (F.col("method") == "boxed").cast("int"), "tokens": F.col("n_tokens")}
        groups = complete_groups(chosen, ["run", "step"], "at", "n_step", sums).where("complete")
        _to_files(groups.select("run", "step", "n", *[(F.col(c) / F.col("n")).alias(a) for c, a in (("correct", "pass_rate"), ("boxed", "boxed_rate"), ("tokens", "mean_tokens"))]), output, checkpoint)

    return job


def running_log(spark: SparkSession, events: str, output: str, checkpoint: str) -> None:
    """Rewards by step so far: (step, n, n_correct), written anew after each batch."""
    schema = spark.read.parquet(events).schema
    stream = spark.readStream.schema(schema).parquet(f"{events}*")  # a pattern, because a single file can't be a stream's base path
    by_step = stream.groupBy(F.floor(F.col("event_id") / 8).cast("long").alias("step")).agg(F.count("*").alias("n"), F.sum((F.col("value") >= 100).cast("long")).alias("n_correct"))
    write = lambda batch, _: batch.write.mode("overwrite").parquet(output)
    by_step.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_health(spark: SparkSession, events: str, output: str, checkpoint: str) -> None:
    """(day, n, n_high) of the days that the watermark (one hour behind the latest event) has closed; rows later than that are dropped."""
    schema = spark.read.parquet(events).schema
    stream = spark.readStream.schema(schema).parquet(f"{events}*").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    days = stream.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 100).alias("n_high"))
    days.select(F.col("window.start").alias("day"), "n", "n_high").writeStream.outputMode("append").format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run(spark: SparkSession, job, source: str) -> DataFrame:
    """The output of a job over all of ``source``."""
    output = scratch(spark, "stream-output")
    job(spark, source, output, scratch(spark, "stream-checkpoint"))
    return spark.read.parquet(output)
