"""Review transcripts: one long text of problems, each with a header and its rollouts, cut into rows and cleaned.

Header: ``3/8 correct concept gold=12 grades=[1, 0, ...]``; rollout: ``--- rollout 2 (graded CORRECT) ---``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
HEADER = r"(\d)/8\s+correct\s+(\S+)\s+gold=(-?[\d/.]+)\s+grades=\[([^\]]+)\]"
ROLLOUT = r"---\s*rollout\s+(\d+)\s*\(graded\s+(CORRECT|WRONG)\)\s*---"
ZONES = "GOLDILOCKS|TOO_HARD|TOO_EASY|BORDERLINE"
#: Where a line break comes back, in this order: before display maths, after it, before words that start a step, and before list numbers.
BREAKS = [(r"\s*\\\[\s*", "\n\\\\[ "), (r"\s*\\\]\s*", " \\\\]\n"), (r"\s+(Step\s+\d+)", "\n$1"), (r"\s+(###+\s)", "\n$1"), (r"\s+(Therefore,|Thus,|So,|Finally,|Hence,)", "\n$1"), (r"(?<=[.\]])\s+(\d{1,2}\.\s)", "\n$1")]
_CUT = "\x01"


def clean(text: Column) -> Column:
    """A body without rules and stray zone words, on single spaces, with line breaks before its steps."""
    text = F.regexp_replace(F.regexp_replace(text, r"_{5,}", " "), rf"\b(?:{ZONES})\b", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    for pattern, by in BREAKS:
        text = F.regexp_replace(text, pattern, by)
    for pattern, by in ((r"\n{3,}", "\n\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, pattern, by)
    return text


def zone(before: Column, n_correct: Column) -> Column:
    """The last zone word before a header, in small letters; without one, what 0 or 8 right answers say."""
    found = F.lower(F.try_element_at(F.regexp_extract_all(before, F.lit(f"({ZONES})"), F.lit(1)), F.lit(-1)))
    return F.coalesce(found, F.when(n_correct == 0, "too_hard").when(n_correct == 8, "too_easy").otherwise(""))


def _after(parts: str, pattern: str) -> Column:
    """``parts`` is a column of text pieces cut before each match; the pieces from the second on, as (match, rest)."""
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.struct(x.alias("whole"), F.regexp_replace(x, rf"(?s)^{pattern}", "").alias("rest")))


def segments(texts: DataFrame) -> DataFrame:
    """(file, place, concept, n_correct, gold, zone, grades, statement, rollouts) from rows (file, text); rollouts are (n, verdict, body). A null text has none."""
    cut = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), f"({HEADER})", f"{_CUT}$1"), _CUT)
    parts = texts.select("file", cut.alias("parts")).withColumn("found", _after("parts", HEADER))
    # what stands before a header is the rest of the piece before it, its own header left out
    before = F.concat(F.array(F.get("parts", F.lit(0))), F.transform("found", lambda x: x["rest"]))
    rows = parts.withColumn("before", before).select("file", "before", F.posexplode("found").alias("place", "h"))
    head = lambda k: F.regexp_extract("h.whole", HEADER, k)
    n_correct = head(1).try_cast("int")
    rows = rows.select(
        "file", "place", head(2).alias("concept"), n_correct.alias("n_correct"), head(3).alias("gold"), zone(F.get("before", F.col("place")), n_correct).alias("zone"),
        F.filter(F.transform(F.split(head(4), ","), lambda x: F.trim(x)), lambda x: x != "").alias("grades"), F.split(F.regexp_replace("h.rest", f"({ROLLOUT})", f"{_CUT}$1"), _CUT).alias("pieces"),
    )
    statement = F.regexp_extract(F.get("pieces", F.lit(0)), r"(?s)PROBLEM\b(.*)", 1)
    roll = F.transform(_after("pieces", ROLLOUT), lambda x: F.struct(F.regexp_extract(x["whole"], ROLLOUT, 1).try_cast("int").alias("n"), F.regexp_extract(x["whole"], ROLLOUT, 2).alias("verdict"), clean(x["rest"]).alias("body")))
    return rows.select("file", "place", "concept", "n_correct", "gold", "zone", "grades", clean(statement).alias("statement"), roll.alias("rollouts"))
