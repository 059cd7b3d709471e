"""Answer extraction and grading as column expressions: no UDF, so all of it stays in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns that decide which text counts as an answer.
NUMBER = r"-?[\d,]+(?:\.\d+)?"
BOXED = r"\\boxed\{\s*(-?\\d?frac\{-?\d+\}\{-?\d+\}|-?[\d,]+(?:/\d+)?(?:\.\d+)?)"
HASHES = r"####\s*(-?[\d,]+(?:\.\d+)?)"
ANSWER_IS = r"[Tt]he\s+(?:final\s+)?answer\s+is\s*:?\s*\$?\s*(-?[\d,]+(?:\.\d+)?)"
BOLD = r"\*\*(-?[\d,]+(?:\.\d+)?)\*\*"
FRACTION = r"^(-?)\\?d?frac\{(-?\d+)\}\{(-?\d+)\}"
PLAIN_GOLD = r"^-?[\d,\./]+$"
PLAIN_BOXED = r"\\boxed\{-?[\d,]+(?:\.\d+)?"
LENIENT_BOXED = r"\\boxed\{([\d,]+(?:\.\d+)?)\}"
LENIENT_LINE = r"(?m)^\s*\$?\s*([\d,]+(?:\.\d+)?)\s*\$?\s*\.?\s*$"
LEGACY_BOXED = r"\\boxed\{(-?[\d,\.]+)\}"
LEGACY_ANSWER = r"[Tt]he\s+(?:final\s+)?answer\s+is\s*:?\s*(-?[\d,\.]+)"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first(text: Column, pattern: str) -> Column:
    return F.get(_all(text, pattern), F.lit(0))


def _last(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(_all(text, pattern, group), F.lit(-1))


def _bare(number: Column) -> Column:
    return F.replace(number, F.lit(","), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, found once: a filter pushed below would otherwise copy it to every place that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_fraction(text: Column) -> Column:
    """A LaTeX fraction as a/b, a leading minus turning the numerator's sign; anything else without commas."""
    return let(text, _clean_fraction)


def _clean_fraction(s: Column) -> Column:
    num, den = (F.regexp_extract(s, FRACTION, k).try_cast("long") for k in (2, 3))
    signed = F.when(F.regexp_extract(s, FRACTION, 1) == "-", -num).otherwise(num)
    return F.when(s.rlike(FRACTION), F.concat(signed.cast("string"), F.lit("/"), den.cast("string"))).otherwise(_bare(s))


def to_number(s: Column) -> Column:
    """Double of a number or of a/b; null for anything else."""
    return let(F.trim(_bare(s)), _to_number)


def _to_number(bare: Column) -> Column:
    parts = F.split(bare, "/")
    ratio = F.when(F.size(parts) == 2, F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")))
    return F.when(F.contains(bare, F.lit("/")), ratio).otherwise(bare.try_cast("double"))


def numbers_match(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(to_number(a) - to_number(b)) < 1e-6, F.lit(False))


def gold_answer(label: Column) -> Column:
    return F.when(F.trim(label).rlike(PLAIN_GOLD), F.trim(label)).otherwise(_bare(_first(label, HASHES)))


def predicted(text: Column) -> Column:
    """struct(pred, method): the last box, else the first of the other marks, else the only number of the text."""
    lone = F.filter(F.array(_all(text, NUMBER, 0)), lambda x: F.size(x) == 1)
    found = {"boxed": _last(text, BOXED), "####": _first(text, HASHES), "the_answer_is": _first(text, ANSWER_IS), "bold": _last(text, BOLD), "single_number_fallback": F.get(F.flatten(lone), F.lit(0))}
    best = lambda m, c: F.transform(F.array_compact(F.array(c)), lambda x: F.struct(x.alias("pred"), F.lit(m).alias("method")))
    first = let(F.concat(*[best(m, c) for m, c in found.items()]), lambda x: F.coalesce(F.get(x, F.lit(0)), F.struct(F.lit(None).cast("string").alias("pred"), F.lit("no_answer").alias("method"))))
    return let(first, lambda x: F.struct(F.when(x["method"] == "boxed", _clean_fraction(x["pred"])).otherwise(_bare(x["pred"])).alias("pred"), x["method"].alias("method")))


def grade(rows: DataFrame, text: str = "response", label: str = "gold") -> DataFrame:
    """``rows`` with pred, method and ok."""
    found = rows.withColumn("_found", predicted(F.col(text)))
    return found.select(*rows.columns, "_found.pred", "_found.method", numbers_match(F.col("_found.pred"), gold_answer(F.col(label))).alias("ok"))


def predicted_lenient(text: Column) -> Column:
    """struct(pred, method) of the lenient variant, without negative numbers: the first box, else the marks, else a line or at last any number."""
    positive = lambda p: p.replace("-?", "")
    steps = [("boxed", _first(text, LENIENT_BOXED)), ("####", _first(text, positive(HASHES))), ("the_answer_is", _first(text, positive(ANSWER_IS))), ("bold", _last(text, positive(BOLD))), ("last_line_number", _last(text, LENIENT_LINE)), ("last_number_fallback", _last(text, positive(NUMBER), 0))]
    method = F.coalesce(*[F.when(p.isNotNull(), F.lit(m)) for m, p in steps], F.lit("no_answer"))
    return F.struct(_bare(F.coalesce(*[p for _, p in steps])).alias("pred"), method.alias("method"))


def predicted_legacy(text: Column) -> Column:
    """The legacy variant's answer: the first box as a whole number, else the marked answer, else the last number."""
    boxed = _bare(_first(text, LEGACY_BOXED))
    return F.coalesce(boxed.try_cast("double").cast("long").cast("string"), boxed, _bare(_first(text, LEGACY_ANSWER)), _last(text, r"-?\d+\.?\d*", 0))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def format_reward(text: Column) -> Column:
    enough = word_count(text) > 30
    return F.when(~enough, -0.2).when(text.rlike(PLAIN_BOXED), 0.1).otherwise(0.0)


def zone(correct: Column, n: Column) -> Column:
    return F.when(correct == 0, "too_hard").when(correct == n, "too_easy").when((4 * correct).between(n, 3 * n), "goldilocks").otherwise("borderline")
