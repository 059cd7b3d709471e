"""Knob specs: validation, the gate for proposed edits, which knobs can be fed by another concept's answers, and pairs of concepts.

A spec is a row (concept, param, type, knob_class, lo, hi, allowed, atoms, words, nested, locked): the envelope is a range lo to hi or a list of allowed
words; the value's numbers are in atoms, its words in words, and nested says that an option is itself a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
TYPES = ("randint", "choice", "const")
CLASSES = ("num", "C", "S")
LEAST_SHARE, LEAST_DISTINCT = 0.5, 5
TARGET_TAGS = {"constrained_divisor_count": (55, 75), "modular_exponent": (55,), "divisor_sum_filter": (55,), "prime_power_divisors": (75,)}


def violation() -> Column:
    """Why a spec isn't valid, the first reason in order; null for a valid one."""
    ranged = F.col("type").isin("randint", "const")
    first, second = F.get("atoms", F.lit(0)), F.get("atoms", F.lit(1))
    whole = (F.size("atoms") == 2) & (F.size("words") == 0) & ~F.col("nested") & (first == F.floor(first)) & (second == F.floor(second)) & (first <= second)
    outside = F.exists("atoms", lambda x: ~x.between(F.col("lo"), F.col("hi")))
    categorical = F.size(F.coalesce("allowed", F.array().cast("array<string>"))) > 0
    return (
        F.when(F.col("type").isNull() | F.col("knob_class").isNull() | (F.col("lo").isNull() & ~categorical) | F.col("atoms").isNull(), "missing_key")
        .when(~F.col("type").isin(*TYPES), "bad_type")
        .when(~F.col("knob_class").isin(*CLASSES), "bad_class")
        .when(ranged & ~F.coalesce(whole, F.lit(False)), "bad_range")
        .when(ranged & ~F.coalesce((F.col("lo") <= first) & (second <= F.col("hi")), F.lit(False)), "outside_envelope")
        .when(~ranged & (F.size("atoms") + F.size("words") == 0), "no_options")
        .when(~ranged & categorical, F.when((F.size("atoms") > 0) | (F.size(F.array_except("words", "allowed")) > 0), "not_allowed"))
        .when(~ranged & (F.size("atoms") == 0), "no_numbers")
        .when(~ranged & outside, "outside_envelope")
    )


def validate(specs: DataFrame) -> DataFrame:
    """(concept, param, reason): reason is null where the spec is valid."""
    return specs.select("concept", "param", violation().alias("reason"))


def edit_gate(proposals: DataFrame, specs: DataFrame) -> DataFrame:
    """(proposal_id, concept, param, verdict) for proposals (proposal_id, concept, param, atoms, words, nested): accepted, or the first rule that it breaks.

    Locked concepts take no edit; the new value must be valid in the old envelope; numbers of class num may be narrowed but not widened.
    """
    concepts = specs.groupBy("concept").agg(F.max("locked").alias("locked"))
    old = specs.select("concept", "param", "type", "knob_class", "lo", "hi", "allowed", F.col("atoms").alias("old_atoms"))
    rows = proposals.join(concepts, "concept", "left").join(old, ["concept", "param"], "left")
    wider = (F.array_min("atoms") < F.array_min("old_atoms")) | (F.array_max("atoms") > F.array_max("old_atoms"))
    verdict = (
        F.when(F.col("locked").isNull(), "unknown_concept")
        .when(F.col("locked"), "locked")
        .when(F.col("old_atoms").isNull(), "unknown_param")
        .when(violation().isNotNull(), F.concat(F.lit("invalid: "), violation()))
        .when((F.col("knob_class") == "num") & wider, "widened")
        .otherwise("accepted")
    )
    return rows.select("proposal_id", "concept", "param", verdict.alias("verdict"))


def no_feed() -> Column:
    """Why answers of another concept can't be fed into a knob; null where they can."""
    return (
        F.when(F.col("type") == "const", "constant")
        .when((F.col("type") != "randint") & (F.size(F.coalesce("allowed", F.array().cast("array<string>"))) > 0), "words")
        .when((F.col("type") != "randint") & F.col("nested"), "structured")
    )


def tags_of(concept: Column) -> Column:
    chain = F.array().cast("array<int>")
    for name, tags in TARGET_TAGS.items():
        chain = F.when(concept == name, F.array(*map(F.lit, tags))).otherwise(chain)
    return chain


def pairs(answers: DataFrame, specs: DataFrame) -> DataFrame:
    """(source, target, param, reason, n, n_in, n_distinct, share, valid, tags) for each concept with answers (concept, value) and each knob of another concept.

    Answers are counted by value first, so the range join has a row for each distinct answer and knob.
    """
    counted = answers.where("value is not null").groupBy(F.col("concept").alias("source"), "value").agg(F.count("*").alias("c"))
    totals = counted.groupBy("source").agg(F.sum("c").alias("n"))  # a row for each concept
    knobs = specs.select(F.col("concept").alias("target"), "param", "lo", "hi", no_feed().alias("reason"))
    edges = knobs.join(F.broadcast(totals), F.col("source") != F.col("target"))
    inside = edges.where("reason is null").join(counted.withColumnRenamed("source", "s"), (F.col("source") == F.col("s")) & F.col("value").between(F.col("lo"), F.col("hi")))
    held = inside.groupBy("source", "target", "param").agg(F.sum("c").alias("n_in"), F.count("*").alias("n_distinct"))
    joined = edges.join(held, ["source", "target", "param"], "left")
    feeds, zero = F.col("reason").isNull(), F.lit(0).cast("long")
    n_in, distinct = F.when(feeds, F.coalesce("n_in", zero)), F.when(feeds, F.coalesce("n_distinct", zero))
    share = F.when(feeds, F.round(F.coalesce(F.col("n_in"), zero) / F.col("n"), 4))
    valid = feeds & (share >= LEAST_SHARE) & (distinct >= LEAST_DISTINCT)
    tags = F.array_sort(F.array_union(tags_of(F.col("source")), tags_of(F.col("target"))))
    return joined.select("source", "target", "param", "reason", "n", n_in.alias("n_in"), distinct.alias("n_distinct"), share.alias("share"), F.coalesce(valid, F.lit(False)).alias("valid"), tags.alias("tags"))


def recommended(edges: DataFrame, rates: DataFrame, strong: float = 0.8, middle: tuple[float, float] = (0.33, 0.49)) -> DataFrame:
    """Valid edges from a concept that is mostly solved to one in the middle; ``rates`` has (concept, mean_pass)."""
    rate = F.broadcast(rates.select("concept", "mean_pass"))  # a row for each concept
    a, b = rate.select(F.col("concept").alias("source"), F.col("mean_pass").alias("source_pass")), rate.select(F.col("concept").alias("target"), F.col("mean_pass").alias("target_pass"))
    rows = edges.where("valid").join(a, "source").join(b, "target")
    return rows.where((F.col("source_pass") >= strong) & F.col("target_pass").between(*middle)).select("source", "target", "param", "share", "source_pass", "target_pass")
