"""Measures of a text: long ones take time in proportion, odd ones have the stated results."""

import time

from rolloutlens.plans.derived import repeated_lines, trigram_repetition


def test_trigram_repetition_of_odd_texts(spark):
    rows = [(1, "a b c a b c a b c"), (2, None), (3, ""), (4, "a b c d"), (5, "x " * 6), (6, "x " * 6), (6, " a\tb\nc  d e "), (None, "q w e r t")]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_repeated"], round(r["ratio"], 6)) for r in trigram_repetition(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as w", "2 as g")).collect())
    assert got == [(0, 5, 0, 0.0), (1, 9, 3, round(3 / 7, 6)), (2, 0, 0, 0.0), (3, 0, 0, 0.0), (4, 4, 0, 0.0), (5, 6, 4, 1.0), (6, 5, 0, 0.0), (6, 6, 4, 1.0)]
    assert trigram_repetition(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trigram_repetition_is_linear(spark):
    text = lambda n: " ".join(str(i % 997) for i in range(n))
    made = lambda n: spark.createDataFrame([(1, text(n))], "doc_id long, text string")
    trigram_repetition(made(2000)).collect()
    began = time.time()
    (row,) = trigram_repetition(made(200_000)).collect()
    assert time.time() - began < 20
    assert (row["n_words"], row["n_repeated"]) == (200_000, 199_998)


def test_repeated_lines_of_odd_texts(spark):
    line = "a line that is long enough\n"
    rows = [(1, line * 3), (2, line * 2), (3, "short\n" * 5), (4, None)]
    assert sorted(map(tuple, repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == [(1, True), (2, False), (3, False), (4, False)]
