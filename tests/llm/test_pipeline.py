"""The pipeline's stages on a small folder of tables, each against a plain version of what it should keep."""

import random
import re

import pytest
from rolloutlens.llm import jaccard_join
from rolloutlens.llm.common import shingle_set

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    prose = lambda n: " ".join(word() + ("\n" if rng.random() < 0.1 else "") for _ in range(n))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(3)]
    base = [prose(120) for _ in range(12)]
    near = base[0].split(" ")
    near[60] = "changed"
    passage = " ".join(word() for _ in range(30)) + "\n" + " ".join(word() for _ in range(30))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, " ".join(near)), (21, base[1]), (None, base[2]), (None, prose(90)), (None, prose(90)), (3, prose(100)), (3, base[3]), (22, "short"), (23, None), (24, ""), (None, None)]
    rows += [(30 + i, prose(60) + "\n" + passage + "\n" + prose(60)) for i in range(3)]
    rows += [(40, prose(80) + " " + items[0][1] + " " + prose(40)), (None, prose(80) + " " + items[1][1]), (41, " ".join(["same words again"] * 60))]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(d, t, ["en", None][k % 2], "s", None if t is None else len(t)) for k, (d, t) in enumerate(rows)], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def _rows(df):
    return sorted([(-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "", r["lang"] or "") for r in df.collect()])


def test_quality_stage_judges_each_row_by_its_own_text(spark, folder):
    want = []
    for d, t, lang in _rows(_docs(spark, folder)):
        words = re.findall(C.WORD + "+", t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {w for w in windows if windows.count(w) > 1}
        repeat = len({i + j for i, w in enumerate(windows) if w in twice for j in range(3)})
        if len(words) >= 50 and 100 * repeat <= 50 * len(words):  # three labels turn no rule on
            want.append((d, t, lang))
    done = C.quality_rules(spark, _docs(spark, folder), folder)
    assert done.columns == list(C.COLUMNS)
    assert _rows(done) == sorted(want) and any(d == -1 for d, _, _ in want)


def test_line_stage_cuts_passages_and_keeps_all_other_rows(spark, folder):
    done = _rows(C.repeated_lines(spark, _docs(spark, folder), folder))
    before = _rows(_docs(spark, folder))
    assert {d for d, _, _ in done} >= {0, 20, 30, 31, 32, 40, 41, 22, 23, 24, -1}
    assert sum(len(t) for d, t, _ in done if d in (31, 32)) < sum(len(t) for d, t, _ in before if d in (31, 32)) - 600
    assert [t for d, t, _ in done if d == 30] == [t for d, t, _ in before if d == 30]


def test_jaccard_stage_keeps_one_row_of_each_group(spark, folder):
    rows = _rows(_docs(spark, folder))
    groups = jaccard_join.brute_force({k: t.encode() for k, (_, t, _) in enumerate(rows)})
    best = {}
    for k, (d, t, _) in enumerate(rows):
        if len(shingle_set(t.encode())):
            best[groups[k]] = min(best.get(groups[k], (2, 0)), (int(d == -1), d))
    done = _rows(C.near_duplicates(spark, _docs(spark, folder), folder))
    wordless = [r for r in rows if not shingle_set(r[1].encode()).size]
    assert len(done) == len(best) + len(wordless)
    assert sorted(d for d, t, _ in done if t.strip()) == sorted(d for _, d in best.values())


def test_decontamination_stage_drops_rows_by_their_own_text(spark, folder):
    items = [shingle_set(r["text"].encode()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    held = lambda t: any(100 * sum(x in set(shingle_set(t.encode()).tolist()) for x in i.tolist()) >= 80 * len(i) for i in items)
    want = [r for r in _rows(_docs(spark, folder)) if not held(r[1])]
    assert _rows(C.benchmark_passages(spark, _docs(spark, folder), folder)) == want and len(want) == _docs(spark, folder).count() - 2


def test_pipeline_runs_to_the_end(spark, folder):
    done = C.run(spark, folder)
    assert done.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kept = {r["doc_id"] for r in done.collect()}
    assert {1, 4, 30, 31} <= kept and not kept & {21, 22, 23, 24, 40, 41}
    assert [name for name, _ in C.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
