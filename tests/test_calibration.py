"""The calibration report on a small pool that can be counted by hand."""

from rolloutlens.operators import calibration as C

BOX, CUT = "Steps lead to \\boxed{7}.", "Steps without an end"
ROLLS = "problem string, arm string, concept string, gold string, rollout_idx int, response string, method string, ok boolean"


def _rows():
    made = {"p1": ("A", "5", [0, 0, 0, 0], [CUT, CUT, BOX, BOX]), "p2": ("A", "5", [1, 1, 0, 0], [BOX] * 4), "p3": ("A", "9", [1, 1, 1, 1], [BOX] * 4), "p4": ("A", "2", [1, 1, 1, 0], [BOX] * 4), "p5": ("B", "3", [1, 0, 1, 0], [BOX, CUT, BOX, BOX])}
    return [(p, arm, c, gold, i, t, "boxed" if t == BOX else "no_answer", bool(o)) for arm in ("x", "y") for p, (c, gold, oks, texts) in made.items() for i, (o, t) in enumerate(zip(oks, texts, strict=True)) if arm == "x" or p == "p5"]


def test_report(spark):
    graded = spark.createDataFrame(_rows(), ROLLS)
    pool = spark.createDataFrame([(1, "p1", {"n": "7", "w": '"b"'}), (2, "p2", {"n": "1"}), (3, "p2", {"n": "7", "w": None}), (4, "p3", {"n": "9"}), (5, "p4", {"n": "9"}), (6, "p5", None), (7, "other", {"n": "7"})], "row_id long, problem string, knobs map<string, string>")
    made = spark.createDataFrame([("A", 0.8), ("C", 0.1)], "concept string, survival double")
    got = {(r["arm"], r["concept"]): r for r in C.report(graded, pool, made, 4).collect()}
    assert set(got) == {("x", "A"), ("x", "B"), ("x", None), ("y", "B"), ("y", None)}
    a = got["x", "A"]
    assert [a[z] for z in C.ZONES] == [0.25, 0.0, 0.5, 0.25] and a["hist"] == [1, 0, 1, 1, 1] and a["truncation"] == 0.125 and a["ghost_frac"] == 0.5
    assert a["top3"] == 1.0 and a["entropy"] == 1.5 and a["survival"] == 0.8 and a["n"] == 4 and a["mean_pass"] == 0.5625
    assert a["n_classified"] == 3 and a["format_failure"] == 0.3333 and a["calculation_error"] == 0.6667 and a["early_termination"] == a["repetition_loop"] == 0.0
    assert [tuple(x) for x in a["params"]] == [("n", "7", 2, 0.25), ("n", "9", 2, 0.875), ("w", '"b"', 1, 0.0), ("w", "null", 1, 0.5)]
    b = got["x", "B"]
    assert b["params"] is None and b["survival"] is None and b["ghost_frac"] == 0.0 and b["format_failure"] == 1.0
    all_ = got["x", None]
    assert all_["truncation"] == 0.15 and all_["ghost_frac"] == 0.4 and all_["mean_pass"] == 0.55 and all_["top3"] is None and all_["params"] is None and all_["survival"] is None


def test_report_without_pool_or_sidecar_and_of_nothing(spark):
    graded = spark.createDataFrame([r for r in _rows() if r[0] == "p3"], ROLLS)
    rows = C.report(graded).collect()
    assert len(rows) == 2 and all(r["params"] is None and r["survival"] is None and r["n_classified"] == 0 and r["format_failure"] is None for r in rows)
    assert C.report(graded.limit(0)).count() == 0
