"""Why a wrong answer is wrong: kinds of failure as column expressions, and the same rules as DuckDB SQL, written apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloutlens.functions.grading import let

#: White space at the ends of a line, besides line feeds.
BLANKS = " \t\r\x0b\x0c"
_NUMBER = r"-?\d[\d,]*\.?\d*"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0b\f\r]+"), lambda w: w != "")


def in_threes(g: Column) -> Column:
    """How many elements of a sorted array occur three times or more: such an element has two equal neighbours."""
    like = lambda i, a, b: F.coalesce((F.get(g, i + a) == F.get(g, i)) & (F.get(g, i + b) == F.get(g, i)), F.lit(False))
    return F.size(F.filter(F.sequence(F.lit(0), F.size(g)), lambda i: like(i, 1, 2) | like(i, -1, 1) | like(i, -2, -1)))


def trigrams(w: Column) -> Column:
    """The runs of three words in order; none below five words."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 5, runs).otherwise(F.array().cast("array<string>"))


def loops(text: Column) -> Column:
    """Whether more than a quarter of the trigrams (in small letters) occur three times or more, or a line of more than 15 characters does."""
    runs = let(F.sort_array(trigrams(words(F.lower(text)))), lambda g: 4 * in_threes(g) > F.size(g))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: F.length(x) > 15)
    return runs | let(F.sort_array(lines), lambda g: in_threes(g) > 0)


def numbers_in(text: Column, pattern: str = f"({_NUMBER})") -> Column:
    """The numbers of a text in order, without commas; what is no number is left out."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())


def gold_steps(text: Column) -> Column:
    """The results of a worked solution: numbers behind an equals sign, then the one behind ####, unless it is the last of those."""
    answer = numbers_in(text, rf"####\s*({_NUMBER})")
    return let(numbers_in(text, rf"=\s*({_NUMBER})"), lambda s: F.concat(s, F.filter(answer, lambda x: F.coalesce(F.abs(x - F.try_element_at(s, F.lit(-1))) >= 1e-6, F.lit(True)))))


def _among(x: Column, numbers: Column) -> Column:
    return F.exists(numbers, lambda y: F.abs(x - y) < 1e-6)


def kind(method: Column, wrong: Column, right: Column, question: Column | None = None, gold_text: Column | None = None) -> Column:
    """The kind of a wrong answer's failure; the rules hold in this order.

    format_failure: no answer could be read. early_termination: fewer than 50 words, and less than 40 % of a right answer's. repetition_loop: ``loops``. With a worked gold solution,
    calculation_error: at least half of its intermediate results that the question doesn't give are in the answer; premise_mismatch: two numbers over 10 or more that neither the question
    nor the solution has. Otherwise calculation_error.
    """
    text = F.coalesce(wrong, F.lit(""))
    n, n_right = F.size(words(text)), F.size(words(F.coalesce(right, F.lit(""))))
    told = F.when(method == "no_answer", "format_failure").when((n_right > 0) & (10 * n < 4 * n_right) & (n < 50), "early_termination").when(loops(text), "repetition_loop")
    if gold_text is not None:
        solution = F.coalesce(gold_text, F.lit(""))
        said = F.struct(numbers_in(text).alias("own"), gold_steps(solution).alias("steps"), numbers_in(F.coalesce(question, F.lit(""))).alias("given"))

        def grounded(s: Column) -> Column:
            middle = F.filter(F.slice(s["steps"], F.lit(1), F.greatest(F.size(s["steps"]) - 1, F.lit(0))), lambda x: ~_among(x, s["given"]))
            foreign = F.array_distinct(F.filter(s["own"], lambda x: (x > 10) & ~_among(x, s["steps"]) & ~_among(x, s["given"])))
            most = let(middle, lambda m: (F.size(m) > 0) & (2 * F.size(F.filter(m, lambda x: _among(x, s["own"]))) >= F.size(m)))
            return F.when(most, "calculation_error").when(F.size(foreign) >= 2, "premise_mismatch")

        told = told.when(solution != "", let(said, grounded))
    return F.coalesce(told, F.lit("calculation_error"))


def first_rollouts(graded: DataFrame) -> DataFrame:
    """(problem_id, arm, concept, wrong, method, right): the first wrong rollout of each problem and arm that has one, and the first right one."""
    firsts = graded.groupBy("problem_id", "arm", "concept").agg(
        F.min_by(F.when(~F.col("ok"), F.struct("response", "method")), F.when(~F.col("ok"), F.col("rollout_idx"))).alias("wrong"),
        F.min_by(F.when(F.col("ok"), F.col("response")), F.when(F.col("ok"), F.col("rollout_idx"))).alias("right"),
    )
    return firsts.where("wrong is not null").select("problem_id", "arm", "concept", F.col("wrong.response").alias("wrong"), F.col("wrong.method").alias("method"), "right")


_SQL_WORDS = "list_filter(string_split_regex({}, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')".format
_SQL_NUMBERS = r"list_filter(list_transform(regexp_extract_all({}, '{}(-?\d[\d,]*\.?\d*)', 1), lambda x: try_cast(replace(x, ',', '') as double)), lambda x: x is not null)".format
_SQL_HAS = "len(list_filter({}, lambda y: abs(x - y) < 1e-6)) > 0".format


def kind_sql(rows: str) -> str:
    """For rows (problem_id, arm, concept, method, wrong, rightly, question, gold_text): the kind of each, in DuckDB's dialect."""
    thrice = "list_filter({0}, lambda x: len(list_filter({0}, lambda y: y = x)) >= 3)".format
    return f"""select problem_id, arm, concept, case when method = 'no_answer' then 'format_failure' when nr > 0 and 10 * nw < 4 * nr and nw < 50 then 'early_termination'
  when 4 * len({thrice('g')}) > len(g) or len({thrice('lines')}) > 0 then 'repetition_loop' when gold_text = '' then 'calculation_error'
  when len(middle) > 0 and 2 * len(list_filter(middle, lambda x: {_SQL_HAS('own')})) >= len(middle) then 'calculation_error'
  when len(list_distinct(list_filter(own, lambda x: x > 10 and not ({_SQL_HAS('steps')}) and not ({_SQL_HAS('given')})))) >= 2 then 'premise_mismatch' else 'calculation_error' end as mode
from (select *, list_filter(steps[1:len(steps) - 1], lambda x: not ({_SQL_HAS('given')})) as middle from (select *, len(w) as nw, case when len(w) >= 5 then list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) else [] end as g,
  list_filter(list_transform(string_split(wrong, chr(10)), lambda x: trim(x, chr(9) || chr(11) || chr(12) || chr(13) || ' ')), lambda x: length(x) > 15) as lines, {_SQL_NUMBERS('wrong', '')} as own, {_SQL_NUMBERS('question', '')} as given,
  list_concat({_SQL_NUMBERS('gold_text', '=\\s*')}, list_filter({_SQL_NUMBERS('gold_text', '####\\s*')}, lambda x: coalesce(abs(x - {_SQL_NUMBERS('gold_text', '=\\s*')}[-1]) >= 1e-6, true))) as steps
  from (select *, {_SQL_WORDS("lower(wrong)")} as w, len({_SQL_WORDS("coalesce(rightly, '')")}) as nr from ({rows}) r0) r1) r2) r3"""
