"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule compares a count with another, in thousandths. In every stratum (language) a rule's cutoffs are tested from the loosest to the
strictest on labelled documents of good quality, up to the first that fails: an exact binomial test of whether the share of good documents
that the rule would reject is below ``risk``: P(Binomial(n, risk) <= rejected) <= ``error`` / (strata * (rules + 1)). A fixed sequence needs
no share of the error for each cutoff, so all these bounds together hold but for a chance of ``error``; a rule whose loosest cutoff fails is
off. Then the rules join in the order of RULES, each only if what they reject together passes the same test. That last test is over cutoffs
chosen on the same documents, so it's a check of the union and no proven bound; the proven bound of the union is ``risk`` times its rules.

With four strata a stratum needs 306 good labelled documents for any rule to be on at ``RISK``; the smallest of sf0.1 has 307.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloutlens.llm.common import written

#: rule: (count, per count, cutoffs in thousandths). A rule rejects a document if 1000 * count > cutoff * per count.
RULES = {
    "symbols": ("n_symbols", "word_chars", (2, 5, 10, 20, 50, 100, 200)),
    "dup_lines": ("n_dup_lines", "n_lines", (50, 100, 200, 300, 400, 500)),
    "repeat_words": ("n_repeat_words", "n_words", (50, 100, 150, 200, 300, 400)),
    "long_words": ("word_chars", "n_words", (8000, 10000, 12000, 15000, 20000)),
    "short_words": ("minus_chars", "n_words", (-3500, -3000, -2500, -2000)),
}
RISK, ERROR = 0.02, 0.05
_BLANKS = " \t\n\x0b\x0c\r"


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_lines (with a word) and n_repeat_words of each whole text; a null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANKS))
    base = docs.select(
        *keep,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("words"),
        F.length(F.translate(text, _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "").alias("lines"),
    )
    n = F.size("words")
    join = lambda a, b: F.concat(a, F.lit(" "), b)
    counted = base.select(
        *keep, n.cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.zip_with(F.zip_with("words", F.slice("words", F.lit(2), n), join), F.slice("words", F.lit(3), n), join).alias("windows"),
    )
    in_order = counted.select(
        *counted.columns[:-1],
        F.sort_array(F.transform(F.slice("windows", F.lit(1), F.greatest(F.size("windows") - 2, F.lit(0))), lambda x, i: F.struct(x.alias("w"), i.alias("i")))).alias("windows"),
    )
    twice = F.zip_with("windows", F.slice("windows", F.lit(2), F.size("windows")), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
    starts = F.flatten(F.array_compact(twice))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))
    return in_order.select(*in_order.columns[:-1], F.size(covered).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _fires(rule: str, cutoff: Column | int) -> Column:
    count, per, _ = RULES[rule]
    return 1000 * (-F.col("word_chars") if count == "minus_chars" else F.col(count)) > cutoff * F.col(per)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed in logarithms; k should be below n * p."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    step = lambda s, i: F.struct(
        (s["term"] + F.log((n - i + 1) / i) + odds).alias("term"),
        (s["total"] + F.log1p(F.exp(s["term"] + F.log((n - i + 1) / i) + odds - s["total"]))).alias("total"),
    )
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.exp(F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), step, lambda s: s["total"]))


def cutoffs(labelled: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, a column for each rule): the strictest safe cutoff, or null. ``labelled`` has features and stratum of good documents, each once."""
    tests = [(rule, c) for rule, (_, _, grid) in RULES.items() for c in grid]
    counts = labelled.groupBy("stratum").agg(F.count("*").alias("n"), *[F.sum(_fires(r, c).cast("long")).alias(f"t{i}") for i, (r, c) in enumerate(tests)])
    counts = counts.crossJoin(counts.select(F.count("*").alias("strata")))  # one row
    passes = lambda k: (k < F.col("n") * risk) & (binomial_cdf(k, F.col("n"), risk) <= error / (F.col("strata") * (len(RULES) + 1)))
    rows = counts.select("stratum", "n", "strata", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"t{i}").alias("rejected")) for i, (r, c) in enumerate(tests)])).alias("t"))
    # a stricter cutoff rejects all that a looser one does, so those before the first failure are those that pass
    alone = rows.where(passes(F.col("t.rejected"))).groupBy("stratum", "n", "strata").agg(*[F.min(F.when(F.col("t.rule") == r, F.col("t.cutoff"))).alias(r) for r in RULES])
    fired = reduce(Column.__add__, [F.when(_fires(r, F.col(r)), 1 << i).otherwise(0) for i, r in enumerate(RULES)])
    masks = labelled.join(F.broadcast(alone.drop("n", "strata")), "stratum").groupBy("stratum", fired.alias("mask")).agg(F.count("*").alias("n"))
    masks = masks.groupBy("stratum").agg(F.collect_list(F.struct("mask", "n")).alias("masks"))
    union = alone.join(masks, "stratum").withColumn("on", F.lit(0))
    for i, r in enumerate(RULES):
        rejected = F.aggregate("masks", F.lit(0).cast("long"), lambda s, x: s + F.when(x["mask"].bitwiseAND(F.col("on") + (1 << i)) != 0, x["n"]).otherwise(0))
        union = union.withColumn("rejected", rejected)
        union = union.withColumn("on", F.when(F.col(r).isNotNull() & passes(F.col("rejected")), F.col("on") + (1 << i)).otherwise(F.col("on")))
    return union.select("stratum", *[F.when(F.col("on").bitwiseAND(F.lit(1 << i)) != 0, F.col(r)).alias(r) for i, r in enumerate(RULES)])


def _inputs(docs: DataFrame, labels: DataFrame, risk: float, error: float, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of ``docs`` by stratum, (doc_id, good) of labelled documents and the cutoffs."""
    table = written(features(docs.withColumn("stratum", F.coalesce(F.col("lang").cast("string"), F.lit(""))), "doc_id", "stratum", *keep), "quality")
    classes = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    return table, classes, cutoffs(table.where(~base_failed()).join(classes.where("good"), "doc_id", "left_semi"), risk, error)


def _rejected() -> Column:
    return reduce(Column.__or__, [F.coalesce(_fires(r, F.col(r)), F.lit(False)) for r in RULES])


def report(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """For each stratum the rules' cutoffs (null: off) and, of labelled documents that pass the base rule, good, good_rejected, bad, bad_rejected."""
    table, classes, limits = _inputs(docs, labels, risk, error)
    seen = table.where(~base_failed()).join(classes, "doc_id").join(limits, "stratum", "left")
    return seen.groupBy("stratum", *RULES).agg(*[F.count_if(c).alias(n) for n, c in (("good", F.col("good")), ("good_rejected", F.col("good") & _rejected()), ("bad", ~F.col("good")), ("bad_rejected", ~F.col("good") & _rejected()))])


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each of ``docs``: doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the ``keep`` columns.

    kept is false if base_failed or a rule with a safe cutoff rejects. A null text has no words, so it fails; a null language is in the
    stratum of empty ones; documents with several labels count as good only if all of them are 1; null labels are left out.
    """
    table, _, limits = _inputs(docs, labels, risk, error, keep)
    return table.join(limits, "stratum", "left").select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~_rejected()).alias("kept"), *keep
    )
