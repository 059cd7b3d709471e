"""The line stage of the pipeline and op3 against plain Python: copied chunks by the rolling hash first, then the windows of all other lines."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from rolloutlens.llm import line_dedup

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    """Few different lines, so that chunks and windows repeat, touch and overlap; also blank lines, whole copies and long runs of one line."""
    rng = random.Random(3)
    few = ["a", "b", "c d", "e", "", " ", "f g h", "i"]
    made = ["\n".join(rng.choice(few) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    many = ["\n".join(f"line {rng.randrange(400)} x" for _ in range(rng.randint(2, 30))) for _ in range(40)]
    return made + many + many[:10] + [many[0] + "\n" + many[1] + "\n" + many[0], "\n".join(["same"] * 15), "\n\n", "one line"]


def _copies(texts):
    """{(document, chunk)} of the chunks that an equal one comes before."""
    seen, found = set(), set()
    for d, t in enumerate(texts):
        lines = t.encode().split(b"\n")
        for k, (a, b) in enumerate(line_dedup.chunk_bounds(lines)):
            if sum(bool(x.strip()) for x in lines[a:b]) >= 2:
                body = tuple(lines[a:b])
                found |= {(d, k)} if body in seen else set()
                seen.add(body)
    return found


def _left(texts):
    """What stays of each text if every window of two worded lines goes that equals an earlier one apart from it."""
    seen, out = {}, []
    for d, t in enumerate(texts):
        lines, gone = t.split("\n"), set()
        full = [i for i, x in enumerate(lines) if x.strip()]
        for a, b in zip(full, full[1:], strict=False):
            at, end = seen.setdefault(tuple(lines[a : b + 1]), (d, b))
            if at != d or a > end:
                gone |= set(range(a, b + 1))
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def _files(spark):
    return set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir())


def test_line_stage_takes_copied_chunks_by_the_rolling_hash(spark, texts):
    before = _files(spark)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r["text"] for r in C.repeated_lines(spark, docs, "").collect()}
    want = _left(texts)
    assert got == {i: t for i, (t, n) in enumerate(want) if n == 0 or t.strip()}
    made = {p.name.rpartition("-")[0]: str(p) for p in _files(spark) - before}
    copies = spark.read.parquet(made["chunk-copies"])
    assert {(r["did"], r["chunk"]) for r in copies.collect()} == _copies(texts) != set()
    # no line window inside a copied chunk is compared by itself
    inside = spark.read.parquet(made["window-bodies"]).alias("w").join(copies.alias("c"), ["did", "th"]).where("w.first >= c.first and w.end <= c.end")
    assert inside.count() == 0


def test_all_repeated_windows_go_beside_the_chunks(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in line_dedup.passage_dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == _left(texts)
    # chunks alone leave some of these lines in place
    alone = line_dedup.line_dedup(docs).agg(F.sum("n_removed_lines")).first()[0]
    assert 0 < alone < sum(n for _, n in _left(texts))


def test_no_shuffle_of_an_earlier_step_stays_on_disk(spark, texts):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = list(env.blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {str(p) for f in folders for p in Path(f).rglob("shuffle_*")}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before, tables = shuffled(), _files(spark)
    done = line_dedup.passage_dedup(docs)
    for _ in range(20):
        if shuffled() <= before:
            break
        time.sleep(0.5)
    assert shuffled() <= before
    assert "line-cuts" not in {p.name.rpartition("-")[0] for p in _files(spark) - tables}
    assert done.count() == len(texts)
