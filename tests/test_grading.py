import pytest
from pyspark.sql import functions as F
from rolloutlens.functions import grading as G

#: (text, gold, correct, method), by rule.
CASES = [
    # a box, with the forms of number it takes
    (r"Adding up, \boxed{118} eggs.", "118", True, "boxed"),
    (r"Adding up, \boxed{117} eggs.", "118", False, "boxed"),
    (r"It falls to \boxed{-17}.", "-17", True, "boxed"),
    (r"The town has \boxed{12,450} people", "12450", True, "boxed"),
    (r"\boxed{   9}", "9", True, "boxed"),
    # fractions, plain and in LaTeX, with either sign
    (r"\boxed{\frac{7}{8}}", "0.875", True, "boxed"),
    (r"\boxed{\dfrac{9}{4}}", "2.25", True, "boxed"),
    (r"\boxed{\frac{5}{6}}", "10/12", True, "boxed"),
    (r"\boxed{-\frac{7}{4}}", "-1.75", True, "boxed"),
    (r"\boxed{-\frac{-7}{4}}", "1.75", True, "boxed"),
    (r"\boxed{3/0}", "3", False, "boxed"),
    # the last box decides
    (r"first \boxed{5}, no: \boxed{6}", "6", True, "boxed"),
    (r"first \boxed{6}, no: \boxed{5}", "6", False, "boxed"),
    # other marks, the first of them by kind
    ("work work #### 31 and then #### 32", "31", True, "####"),
    ("Hence the final answer is: $2,048", "2048", True, "the_answer_is"),
    ("the answer is 0.2", "1/5", True, "the_answer_is"),
    ("We find **77** and at last **78**", "78", True, "bold"),
    # a lone number counts, a list of candidates earns nothing
    ("63", "63", True, "single_number_fallback"),
    ("Perhaps 61, 62 or 63", "63", False, "no_answer"),
    ("as 7 times 9 makes 63, take 60", "63", False, "no_answer"),
    ("No idea.", "63", False, "no_answer"),
    # nulls
    (None, "63", False, "no_answer"),
    ("63", None, False, "single_number_fallback"),
]


def test_grade(spark):
    rows = spark.createDataFrame([(i, t, g) for i, (t, g, _, _) in enumerate(CASES)], "id int, response string, gold string")
    got = {r["id"]: (r["ok"], r["method"]) for r in G.grade(rows).collect()}
    assert got == {i: (ok, m) for i, (_, _, ok, m) in enumerate(CASES)}


@pytest.mark.parametrize(("correct", "n", "zone"), [(0, 12, "too_hard"), (2, 12, "borderline"), (3, 12, "goldilocks"), (9, 12, "goldilocks"), (10, 12, "borderline"), (12, 12, "too_easy")])
def test_zone(spark, correct, n, zone):
    assert spark.range(1).select(G.zone(F.lit(correct), F.lit(n))).first()[0] == zone


def test_variants(spark):
    rows = spark.createDataFrame([(r"\boxed{8.0} beside 3",), ("either 14 or 15",), ("The answer is: 90",), ("nothing",)], "t string")
    got = rows.select(G.predicted_lenient(F.col("t"))["pred"].alias("a"), G.predicted_legacy(F.col("t")).alias("b"), G.format_reward(F.col("t")).alias("f")).collect()
    assert [(r["a"], r["b"], r["f"]) for r in got] == [("8.0", "8", -0.2), ("15", "15", -0.2), ("90", "90", -0.2), (None, None, -0.2)]
