"""URL filter: rules first, then a naive Bayes over the words of host and path.

Concatenated host names are split by a unigram Viterbi whose word counts come from all pages' visible text. The substrings of each distinct
label are looked up in the counts by a join, so no vocabulary is broadcast. The classifier is multinomial naive Bayes, trained on all pages that no rule fits: those with a seed word in the host against all others. Ruled pages are in neither
class, or the words that the rules name would carry the verdict. Each class gets one extra count a token on average, dealt by the tokens'
overall shares, so that a rare token doesn't speak for the smaller class and an unknown one says nothing. Counts and scores are joins and sums.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloutlens.llm.common import written

LONGEST_WORD = 20
#: Words that mark a host as blocked in training, wherever they stand in it.
SEEDS = ("casino", "pills", "bets", "spam", "ads")


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path): host between the first :// and /, ?, # or the end, A-Z lower-cased; path up to ?, # or the end. Null or without ://, both empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    lower = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select("page_id", lower.alias("host"), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1).alias("path"))


def rule_column(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """struct(verdict, rule) of the longest fitting rule, or null. ``rules`` are (verdict, host and path)."""
    chain = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        of, _, start = rule.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(f"/{start}"))
        chain = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(chain)
    return chain


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over the visible text of all pages, without scripts, styles and comments: lower-case runs of a-z up to LONGEST_WORD long."""
    shown = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.lower(F.regexp_replace(shown, r"<[^>]*>", " "))
    return pages.select(F.explode(F.split(text, "[^a-z]+")).alias("word")).where(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable words; an unknown word of length k has probability 10 / (total * 10 ** k). Ties go to the longer last word."""
    best = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        scores = []
        for start in range(max(0, end - LONGEST_WORD), end):
            n = counts.get(label[start:end], 0)
            scores.append((best[start][0] + (math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)), -start))
        score, start = max(scores)
        best.append((score, -start))
    words, end = [], len(label)
    while end:
        words.append(label[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for distinct labels."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    spans = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("at")).select(
        "label", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("label") - F.col("at") + 1)), lambda k: F.substring(F.col("label"), F.col("at"), k))).alias("word")
    )
    known = spans.distinct().join(counts, "word").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))
    ready = labels.join(known, "label", "left").crossJoin(total)  # total is one row

    def split(frames):
        for frame in frames:
            words = [viterbi(label, dict(known or {}), total + 1) for label, known, total in zip(frame["label"], frame["known"], frame["total"], strict=True)]
            yield pd.DataFrame({"label": frame["label"], "words": words})

    return ready.mapInPandas(split, "label string, words array<string>")


def marked_names(pages: DataFrame, rules: list[tuple[str, str]], seeds: tuple[str, ...]) -> DataFrame:
    """(host, path, pages, host_words, path_words, rule, block) for distinct host and path. block, the class, is 1 with a seed word in the host and else 0; null if a rule fits."""
    urls = parsed(pages)
    names = urls.groupBy("host", "path").agg(F.count("*").alias("pages"))
    labels = names.select("host").distinct().select("host", F.posexplode(F.split("host", "[^a-z]+")).alias("place", "label")).where("label <> ''")
    words = segmented(labels.select("label").distinct(), written(word_counts(pages), "url-counts"))
    hosts = labels.join(words, "label").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"])).alias("host_words"))
    path_words = F.transform(F.filter(F.split(F.lower("path"), "[^a-z0-9]+"), lambda x: x != ""), lambda x: F.when(x.rlike("^[0-9]+$"), "0").otherwise(x))
    empty = F.array().cast("array<string>")
    named = names.join(hosts, "host", "left").select("host", "path", "pages", F.coalesce("host_words", empty).alias("host_words"), path_words.alias("path_words"))
    rule = rule_column(rules, F.col("host"), F.col("path"))
    seeded = reduce(Column.__or__, [F.array_contains("host_words", s) for s in seeds], F.lit(False))
    return named.withColumn("rule", rule).withColumn("block", F.when(F.col("rule").isNull(), seeded.cast("int")))


def log_odds(train: DataFrame, names: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """(host, path, log_odds) of ``names`` by a model of ``train``, both as in marked_names; ``hidden`` host words of ``names`` don't count."""
    tokens = lambda words: F.explode(F.concat(F.transform(words, lambda x: F.concat(F.lit("h:"), x)), F.transform("path_words", lambda x: F.concat(F.lit("p:"), x)))).alias("token")
    trained = train.where("block is not null")
    per_token = written(trained.select("block", "pages", tokens(F.col("host_words"))).groupBy("token").agg(F.sum(F.when(F.col("block") == 1, F.col("pages")).otherwise(0)).alias("b"), F.sum(F.when(F.col("block") == 0, F.col("pages")).otherwise(0)).alias("a")), "url-tokens")
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = per_token.agg(zero(F.sum("b")).alias("tb"), zero(F.sum("a")).alias("ta"), F.count("*").alias("v"))
    priors = trained.agg(zero(F.sum(F.when(F.col("block") == 1, F.col("pages")))).alias("nb"), zero(F.sum(F.when(F.col("block") == 0, F.col("pages")))).alias("na"))
    one = sums.crossJoin(priors)  # one row each
    share = F.col("v") * (F.col("b") + F.col("a")) / (F.col("tb") + F.col("ta"))  # of v extra counts a class
    odds = F.log((F.col("b") + share) / (F.col("tb") + F.col("v"))) - F.log((F.col("a") + share) / (F.col("ta") + F.col("v")))
    model = per_token.crossJoin(one).select("token", odds.alias("odds"))
    prior = one.select(F.log((F.col("nb") + 1) / (F.col("na") + 1)).alias("prior"))
    seen = F.array_except("host_words", F.array(*map(F.lit, hidden))) if hidden else F.col("host_words")
    scores = names.select("host", "path", tokens(seen)).join(model, "token", "left").groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    return names.select("host", "path").join(scores, ["host", "path"], "left").crossJoin(prior).select("host", "path", (F.col("prior") + zero(F.col("odds"))).alias("log_odds"))


def held_out(pages: DataFrame, rules: list[tuple[str, str]], seeds: tuple[str, ...] = SEEDS, folds: int = 5, hide: bool = False) -> DataFrame:
    """(block, verdict, pages): pages without a rule by class and verdict, each host judged by a model of the other folds' hosts; ``hide`` takes the seed words out of the judged hosts."""
    names = written(marked_names(pages, rules, seeds), "url-names").where("block is not null").withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(folds)))
    parts = [log_odds(names.where(F.col("fold") != k), names.where(F.col("fold") == k), seeds if hide else ()) for k in range(folds)]
    judged = names.join(reduce(DataFrame.unionAll, parts), ["host", "path"])
    return judged.groupBy("block", F.when(F.col("log_odds") > 0, "block").otherwise("allow").alias("verdict")).agg(F.sum("pages").alias("pages"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_words) for each row of ``pages``.

    A page that no rule fits gets the classifier's verdict: block if its log odds are above 0. Null urls have an empty host and path and
    are judged by the prior; null html adds no words; repeated rows come out each.
    """
    marked = written(marked_names(pages, rules, seeds), "url-names")
    known = marked.join(log_odds(marked, marked), ["host", "path"]).select(
        "host", "path", F.col("rule.rule").alias("rule"), F.coalesce(F.col("rule.verdict"), F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "host_words"
    )
    return parsed(pages).join(known, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "host_words")
