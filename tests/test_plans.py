"""Recomputed golds, gates, specs, transcripts and CSV on small literal tables."""

from math import gcd

import pytest
from pyspark.sql import functions as F

from rolloutlens.functions import failures, recompute
from rolloutlens.operators import specs, transcripts
from rolloutlens.plans import compare, difficulty, golds
from rolloutlens.sources import files

#: (concept, text, gold) in wordings that the table fixtures don't use.
TEXTS = [
    ("continued_fraction", "It has 4 entries: a fraction with 4 total 3's", 109 + 33),
    ("modular_exponent", "Take 7 to the power 13 and give the remainder modulo 11.", 7**13 % 11),
    ("constrained_divisor_count", "Of the divisors of 360, how many are less than 12?", sum(360 % d == 0 for d in range(1, 12))),
    ("lattice_points_circle", "Count (x, y) with x^2+y^2 < 4^2 or on it.", 49),
    ("telescoping_mn", "1/(k(k + 2)) for k = 1, ..., 20", (n := 20 * 65, d := 4 * 21 * 22, (n + d) // gcd(n, d))[-1]),
    ("complement_prob_mn", "How many rolls of a 6-sided die?", 4),
    ("poly_remainder", "Where does 2x^3 -3x^2 +1x -4 equal 20?", None),
    ("poly_remainder", "Where does 2x^3 -3x^2 +1x -4 equals 26?", 3),
    ("log_laws", "log_5(125) + log_5(25) - log_5(5)", 4),
    ("log_laws", "log_5(124)", None),
    ("prime_power_divisors", "smallest with exactly 6 positive divisors", 12),
    ("lcm_gcd_system", "nothing to read", None),
    ("no_such_concept", "7 8 9", None),
    ("custom_binary_op", None, None),
]


def test_recomputed_golds(spark):
    rows = spark.createDataFrame([(i, c, t) for i, (c, t, _) in enumerate(TEXTS)], "row_id long, concept string, problem string")
    got = {r["row_id"]: r["recomputed"] for r in recompute.with_recomputed(rows).collect()}
    assert got == {i: g for i, (_, _, g) in enumerate(TEXTS)}


def test_gate_of_golds(spark):
    columns = "row_id long, concept string, problem string, answer string, recomputed long"
    rows = [
        (1, "log_laws", "a", "5", 5), (2, "log_laws", "a", "5", 5), (3, "log_laws", "b", "6.0", 6),  # right, one text twice
        (4, "box_diagonal_sq", "c", "5", 6),  # wrong
        (5, "unheard_of", "d", "5", None),  # nothing can read it
        (6, "unheard_of_2", "e", "5", None), (7, "unheard_of_2", "e", "6", None),  # two golds for one text
        (8, "count_pythagorean", "f", "5", None),  # no text could be read
        (9, "modular_exponent", "g", None, 4),  # no gold
    ]
    got = {r["concept"]: r["ok"] for r in golds.gate(spark.createDataFrame(rows, columns)).collect()}
    assert got == {"log_laws": True, "box_diagonal_sq": False, "unheard_of": None, "unheard_of_2": False, "count_pythagorean": False, "modular_exponent": False}


def test_repair_of_golds(spark):
    rows = [(2, "continued_fraction", "x", "7", 9), (1, "continued_fraction", "x", "8", 9), (3, "log_laws", "y", "7", 9), (4, "continued_fraction", "z", "9", 9), (5, "continued_fraction", "u", "4", None)]
    got = {tuple(r) for r in golds.repair(spark.createDataFrame(rows, "row_id long, concept string, problem string, answer string, recomputed long")).collect()}
    assert got == {(1, "continued_fraction", "x", "9", True), (3, "log_laws", "y", "7", False), (4, "continued_fraction", "z", "9", False), (5, "continued_fraction", "u", "4", False)}


SPEC = "concept string, param string, type string, knob_class string, lo double, hi double, allowed array<string>, atoms array<double>, words array<string>, nested boolean, locked boolean"


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        (("randint", "num", 0.0, 9.0, None, [1.0, 9.0], [], False), None),
        (("randint", "num", 0.0, 9.0, None, [1.0, 10.0], [], False), "outside_envelope"),
        (("const", "C", 0.0, 9.0, None, [5.0, 4.0], [], False), "bad_range"),
        (("const", "C", 0.0, 9.0, None, [5.5, 6.0], [], False), "bad_range"),
        (("choice", "S", 0.0, 9.0, None, [], [], False), "no_options"),
        (("choice", "S", 0.0, 9.0, None, [], ["a"], False), "no_numbers"),
        (("choice", "S", 0.0, 9.0, None, [2.0, 9.5], [], True), "outside_envelope"),
        (("choice", "S", None, None, ["a", "b"], [], ["a"], False), None),
        (("choice", "S", None, None, ["a", "b"], [], ["a", "c"], False), "not_allowed"),
        (("range", "S", 0.0, 9.0, None, [1.0, 2.0], [], False), "bad_type"),
        (("choice", "Z", 0.0, 9.0, None, [1.0], [], False), "bad_class"),
        (("choice", "S", None, None, None, [1.0], [], False), "missing_key"),
    ],
)
def test_spec_validation(spark, row, reason):
    made = spark.createDataFrame([("c", "p", *row, False)], SPEC)
    assert specs.validate(made).first()["reason"] == reason


def test_edits_of_specs(spark):
    made = spark.createDataFrame([("c", "p", "randint", "num", 0.0, 99.0, None, [10.0, 20.0], [], False, False), ("c", "q", "randint", "C", 0.0, 99.0, None, [10.0, 20.0], [], False, False), ("l", "p", "randint", "num", 0.0, 9.0, None, [1.0, 2.0], [], False, True)], SPEC)
    edits = [("c", "p", [11.0, 20.0]), ("c", "p", [9.0, 20.0]), ("c", "q", [9.0, 20.0]), ("c", "q", [9.0, 200.0]), ("c", "r", [1.0, 2.0]), ("l", "p", [1.0, 1.0]), ("n", "p", [1.0, 1.0])]
    proposals = spark.createDataFrame([(i, c, p, v, [], False) for i, (c, p, v) in enumerate(edits)], "proposal_id int, concept string, param string, atoms array<double>, words array<string>, nested boolean")
    got = {r["proposal_id"]: r["verdict"] for r in specs.edit_gate(proposals, made).collect()}
    assert [got[i] for i in range(7)] == ["accepted", "widened", "accepted", "invalid: outside_envelope", "unknown_param", "locked", "unknown_concept"]


def test_transcripts(spark):
    text = (
        "TOO_EASY and GOLDILOCKS 3/8 correct sums gold=12 grades=[1, 0, 1]\nPROBLEM Add  five\nand seven. ______ --- rollout 1 (graded CORRECT) ---\nIt   is 12. Therefore, done.\n--- rollout 2 (graded WRONG) --- 1. one 2. two"
        " 8/8 correct more gold=-1/2 grades=[1] PROBLEM none 0/8  correct last gold=0.5 grades=[ 0,0 ]"
    )
    rows = transcripts.segments(spark.createDataFrame([("f", text), ("empty", ""), ("null", None)], "file string, text string")).orderBy("place").collect()
    assert [(r["file"], r["concept"], r["n_correct"], r["gold"], r["zone"], r["grades"]) for r in rows] == [("f", "sums", 3, "12", "goldilocks", ["1", "0", "1"]), ("f", "more", 8, "-1/2", "too_easy", ["1"]), ("f", "last", 0, "0.5", "too_hard", ["0", "0"])]
    assert rows[0]["statement"] == "Add five and seven."
    assert [(x["n"], x["verdict"], x["body"]) for x in rows[0]["rollouts"]] == [(1, "CORRECT", "It is 12.\nTherefore, done."), (2, "WRONG", "1. one 2. two")]


def test_csv_keeps_quotes_line_feeds_nulls_and_empty_texts(spark):
    rows = [(1, 'a "quoted", text'), (2, "two\nlines"), (3, None), (4, ""), (5, " spaced "), (6, "back\\slash")]
    got = files.round_trip(spark.createDataFrame(rows, "id long, text string"), "csv")
    assert sorted(map(tuple, got.collect())) == rows


def test_columnar_tables(spark):
    made = spark.createDataFrame([("v10", ["a", "b"], [["1", "x"], ["2", "y"]]), ("draft", ["a"], [["3"]])], "name string, columns array<string>, data array<array<string>>")
    got = sorted((r["version"], r["row_no"], r["cells"]) for r in files.read_columnar(made).collect())
    assert got == [(0, 0, {"a": "3"}), (10, 0, {"a": "1", "b": "x"}), (10, 1, {"a": "2", "b": "y"})]


def test_numeric_golds(spark):
    golds_ = ["7", "-7", "1/2", "0.5", "7x", "-x", "", " 12 ", "1,000", "1/2/3"]
    got = spark.createDataFrame([(g,) for g in golds_], "g string").select(F.trim("g").rlike(compare.NUMERIC_GOLD).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, True, True, True, False, False, False, True, False, False]


def test_display_maths_keeps_one_backslash(spark):
    rows = spark.createDataFrame([("a  \\[ x = 1 \\]  b. 2. c\n\n\nThus, d",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(transcripts.clean(F.col("t"))).collect()] == ["a\n\\[ x = 1 \\]\nb.\n2. c\nThus, d", "", None]


#: (kind, question, worked solution, wrong answer, right answer)
KINDS = [
    ("format_failure", "q", "", "no answer here", "one two three"),
    ("early_termination", "q", "", "It is \\boxed{5}", "a b c d e f g h i j"),
    ("repetition_loop", "q", "", "go on and Go On And go on AND go on and \\boxed{5}", None),
    ("repetition_loop", "q", "", "\\boxed{5}\n the very same line \nx\nthe very same line\t\nthe very same line", None),
    ("calculation_error", "q", "", "the very same line\nthe very same line\n\\boxed{5} 777 888", None),
    ("calculation_error", "Take 3 and 4", "3*4=12, 12+1,000=1,012, 1012/2=506 #### 506", "12 then 777 then 888 so \\boxed{500}", None),
    ("premise_mismatch", "Take 3 and 4", "3*4=12, 12+1000=1012, 1012/2=506 #### 506", "777 then 888.5 so \\boxed{9}", None),
    ("calculation_error", "Take 3 and 4", "3*4=12, 12+1000=1012, 1012/2=506 #### 506", "777 then 777 so \\boxed{9}", None),
    ("calculation_error", "Take 777 and 888", "1*4=5 #### 5", "777 then 888 so \\boxed{9}", None),
    ("premise_mismatch", "Take 12", "3*4=12 #### 40", "12 then 99 and 98 so \\boxed{9}", None),
    ("calculation_error", None, None, "777 then 888 so \\boxed{9}", ""),
]


def test_kinds_of_failure(spark):
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(KINDS)], "i int, want string, question string, gold_text string, wrong string, rightly string")
    method = F.when(F.contains("wrong", F.lit("boxed")), "boxed").otherwise("no_answer")
    got = rows.select("i", failures.kind(method, F.col("wrong"), F.col("rightly"), F.col("question"), F.col("gold_text")).alias("k"))
    assert {r["i"]: r["k"] for r in got.collect()} == {i: k[0] for i, k in enumerate(KINDS)}


def test_bands(spark):
    rows = spark.createDataFrame([(c,) for c in (0, 1, 2, 6, 7, 8, 12, 13)], "c int")
    assert [r[0] for r in rows.select(difficulty.band(F.col("c"), 2, 6)).collect()] == ["hard", "hard", "sweet", "sweet", "easy", "easy", "easy", "easy"]
    assert [r[0] for r in rows.select(difficulty.band(F.col("c"), 2, 12)).collect()] == ["hard", "hard", "sweet", "sweet", "sweet", "sweet", "sweet", "easy"]


def test_long_texts_of_keys_whose_squares_pass_64_bits(spark, tmp_path):
    keys = [0, 8, 303_698, 303_700, 1_199_998, 1_199_991, 1_199_997, 3_100_000_008, 10_000_000_007, 3_100_000_001, None]
    rows = [(k, 7) for k in keys for _ in range(2)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r["row_id"], r["digits"], r["reason"]) for r in golds.recompute_long(spark, str(tmp_path)).collect()}
    b = lambda a: 7 + a % 13
    value = {0: lambda a: (a + 100001) * (b(a) + 200001) * (a % 31 + 21 + 300001) * (a + 400001) - 1, 1: lambda a: (n := a * 100003 + b(a)) * n * (4 * n + 3), 7: lambda a: ((a * 1000000007 + b(a)) ** 2 + 6) // 12, 8: lambda a: ((a + 5) * 10**4 - 1) // 12}
    told = lambda k, v: (k, str(v), "-" if v < 2**63 else "overflow")
    assert got == {told(k, value[k % 10](k)) for k in keys if k is not None} | {(None, "-", "unknown_concept")}


def test_named_texts_keep_names_line_ends_and_marks(spark, tmp_path):
    rows = [(f"n {i}/é", f"one\r\ntwo\n\nthree {i}\n") for i in range(300)] + [(None, "no name"), ("empty", ""), ("null", None), ("mark", "a\x02b\x03c"), ("mark\x02\x03", "\x03\x03"), ("twice", "x"), ("twice", "y")]
    path = str(tmp_path / "texts")
    files.write_named_texts(spark.createDataFrame(rows, "file string, text string").repartition(3), path)
    got = [tuple(r) for r in files.read_named_texts(spark, path).collect()]
    assert sorted(got, key=str) == sorted(((n, (t or "").replace("\x02", "")) for n, t in rows), key=str)
    assert len(list((tmp_path / "texts").rglob("*.txt"))) == 3  # not one for each text
