"""Streams that are stopped and started again, repeated rows, groups that never fill up, and the trailing log against plain Python."""

import datetime
import random

from pyspark.sql import functions as F

from rolloutlens.plans import training
from rolloutlens.streaming import jobs

ROLLS = "problem_id long, arm string, concept string, rollout_idx int, n_rollouts long, gold string, response string, n_tokens int"


def _rolls(seed=1):
    rng = random.Random(seed)
    rows = []
    for p in range(60):
        for i in range(k := rng.choice([1, 4, 8])):
            rows.append((p, "base", f"c{p % 3}", i, k, "7", rng.choice(["\\boxed{7}", "\\boxed{8}", "#### 7", "nothing"]), i))
    rows += rng.sample(rows, 40)  # repeats
    rows += [(99, "base", "c", 0, 3, "7", "#### 7", 1), (None, "base", "c", 0, 1, "7", "#### 7", 1), (98, "base", "c", None, 1, "7", "#### 7", 1)]
    rng.shuffle(rows)
    return rows


def _in_two_runs(spark, rows, schema, job, tmp_path):
    source, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    half = len(rows) // 2
    spark.createDataFrame(rows[:half], schema).repartition(5).write.parquet(source)
    job(spark, source, output, checkpoint)
    first = spark.read.parquet(output).count()
    spark.createDataFrame(rows[half:], schema).repartition(5).write.mode("append").parquet(source)
    job(spark, source, output, checkpoint)
    job(spark, source, output, checkpoint)  # nothing new
    return first, spark.read.parquet(output).collect()


def test_calibration_goes_on_after_a_restart(spark, tmp_path):
    rows = _rolls()
    first, got = _in_two_runs(spark, rows, ROLLS, jobs.calibrate_stream, tmp_path)
    groups = {}
    for p, arm, concept, i, k, _, text, _ in rows:
        if i is not None:
            groups.setdefault((p, arm, concept, k), {})[i] = text in ("\\boxed{7}", "#### 7")
    want = {(p, arm, c, k, sum(g.values())) for (p, arm, c, k), g in groups.items() if len(g) == k}
    assert {(r["problem_id"], r["arm"], r["concept"], r["n"], r["correct"]) for r in got} == want and len(got) == len(want)
    assert 0 < first < len(want) and 99 not in {r["problem_id"] for r in got} and None in {r["problem_id"] for r in got}
    assert all(r["zone"] == ("too_hard" if not r["correct"] else "too_easy" if r["correct"] == r["n"] else "goldilocks" if 0.25 <= r["pass_rate"] <= 0.75 else "borderline") for r in got)


def test_grades_come_once(spark, tmp_path):
    rows = [r for r in _rolls(2) if r[0] is not None and r[3] is not None]
    first, got = _in_two_runs(spark, rows, ROLLS, jobs.grade_stream, tmp_path)
    assert sorted((r["problem_id"], r["arm"], r["rollout_idx"]) for r in got) == sorted({(r[0], r[1], r[3]) for r in rows})
    assert 0 < first < len(got)


def test_health_at_the_first_each_fifth_and_the_last_step(spark, tmp_path):
    rng = random.Random(3)
    rows = [("r", s, i, 6, 13, "7", rng.choice(["\\boxed{7}", "\\boxed{8}", "#### 7"]), rng.randrange(50)) for s in range(14) for i in range(6)]
    rng.shuffle(rows)
    _, got = _in_two_runs(spark, rows, "run string, step long, at int, n_step long, last_step long, gold string, response string, n_tokens int", jobs.health_stream(5), tmp_path)
    assert sorted(r["step"] for r in got) == [0, 5, 10, 13]
    for r in got:
        own = [x for x in rows if x[1] == r["step"]]
        assert r["n"] == 6 and abs(r["pass_rate"] - sum("7" in x[6] for x in own) / 6) < 1e-9 and abs(r["boxed_rate"] - sum("boxed" in x[6] for x in own) / 6) < 1e-9
        assert abs(r["mean_tokens"] - sum(x[7] for x in own) / 6) < 1e-9


def test_groups_that_never_fill_up_are_told_after_their_time(spark, tmp_path):
    source, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "g long, i long, n_of long, v double, at timestamp"
    when = lambda second: datetime.datetime(2024, 1, 1, 0, 0, second)

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = jobs._stream(spark, source).withWatermark("at", "1 second")
        jobs._to_files(jobs.complete_groups(stream, ["g"], "i", "n_of", {"v": F.col("v")}, "at", 5000), output, checkpoint)

    run([(1, 0, 3, 1.0, when(0)), (2, 0, 1, 2.0, when(0)), (4, 0, 2, 1.0, when(0))])
    run([(4, 1, 2, 3.0, when(3))])
    run([(3, 0, 1, 5.0, when(50))])
    assert {tuple(r) for r in spark.read.parquet(output).collect()} == {(2, 1, 2.0, True), (4, 2, 4.0, True), (1, 1, 1.0, False), (3, 1, 5.0, True)}


def test_trailing_log(spark):
    rng = random.Random(4)
    log, seq = {}, 0
    for run in ("a", "b", None):
        for s in range(1, 23):
            for _ in range(rng.choice([0, 1, 3, 9])):
                seq += 1
                log.setdefault(run, []).append((run, s, seq, float(s % 2)))
    rows = [r for x in log.values() for r in x if r[0] is not None]
    got = sorted(map(tuple, training.trailing_dumps(spark.createDataFrame(rows, "run string, step long, seq long, reward double"), 10, 5).collect()))
    want = []
    for run in ("a", "b"):
        for s in sorted({r[1] for r in log[run]}):
            if s % 5 == 0:
                want += [(run, s, k, *r[1:]) for k, r in enumerate([r for r in log[run] if r[1] <= s][-10:], 1)]
    assert got == sorted(want)
    assert training.trailing_dumps(spark.createDataFrame([], "run string, step long, seq long, reward double")).count() == 0


def test_states_of_many_groups_are_one_state(spark, tmp_path):
    source, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    big = 2**53 + 1  # no float
    rows = [(big + g, f"s{g % 2}" if g % 3 else None, i, 2, float(g)) for g in range(4000) for i in (0, 1, 1)] + [(None, None, 0, 1, None), (None, "x", 0, 2, 1.0)]
    spark.createDataFrame(rows, "g long, s string, i long, n_of long, v double").repartition(3).write.parquet(source)
    groups = jobs.complete_groups(jobs._stream(spark, source), ["g", "s"], "i", "n_of", {"v": F.col("v")})
    query = groups.writeStream.outputMode("append").format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= jobs.BUCKETS
    want = {(big + g, f"s{g % 2}" if g % 3 else None, 2, 2.0 * g, True) for g in range(4000)} | {(None, None, 1, 0.0, True)}
    got = [tuple(r) for r in spark.read.parquet(output).collect()]
    assert set(got) == want and len(got) == len(want)


def test_small_files_are_one_batch_and_states_are_on_disk(spark, tmp_path):
    rows = [r for r in _rolls(5) if r[0] is not None and r[3] is not None]
    source, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame(rows, ROLLS).repartition(24).write.parquet(source)
    jobs.grade_stream(spark, source, output, checkpoint)
    assert sorted((r["problem_id"], r["arm"], r["rollout_idx"]) for r in spark.read.parquet(output).collect()) == sorted({(r[0], r[1], r[3]) for r in rows})
    assert [p.name for p in (tmp_path / "check" / "commits").iterdir() if not p.name.startswith(".")] == ["0"]
    assert "RocksDBStateStoreProvider" in (tmp_path / "check" / "offsets" / "0").read_text()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None
