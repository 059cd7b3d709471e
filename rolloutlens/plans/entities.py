"""Entity names of texts and the reports on how many a text has. Each entry of QUERIES is (Spark query, oracle), as in ``derived``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlens.sources import views

#: Capitalised words that name no one, all days, months and other words of the reference.
EXCLUDED = (
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "May", "June", "July", "August",
    "September", "October", "November", "December", "If", "How", "What", "When", "Where", "Who", "Why", "Which", "The", "He", "She", "They", "His", "Her", "It",
    "Its", "Their", "Each", "Every", "Some", "All", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten", "This", "That", "These",
    "Those", "There", "Here", "After", "Before", "During", "Since", "While", "Until", "In", "On", "At", "For", "From", "By", "To", "Of", "With", "But", "And",
    "Or", "So", "Yet", "Then", "Than", "Also", "An", "A", "As", "Be", "Do", "Is", "Was", "Are", "Were", "Has", "Had", "Have", "Can", "Could", "Would", "Should",
    "Not", "No", "Yes", "Both", "Many", "Most", "Only", "Step", "Answer", "Total", "Calculate", "Find", "Determine", "Given", "Let", "Solve", "Note", "Problem",
    "Solution", "Half", "Twice", "Double", "Triple", "Quarter", "UV", "Art", "TV", "DVD", "GPS", "ATM", "GPA", "SAT", "ACT", "NFL", "NBA", "MLB", "USA", "US",
    "UK", "PM", "AM", "North", "South", "East", "West", "Central", "City", "Town", "Street", "Avenue", "Road", "Park", "Drive", "Lake", "River", "Mountain",
    "Island", "Valley", "Beach", "Bay", "York", "Angeles", "Francisco", "Diego", "America", "American", "European", "African", "Asian", "German", "French",
    "Chinese", "Japanese", "Italian", "Spanish", "English", "British", "Mexican", "Canadian", "Facebook", "Instagram", "Twitter", "YouTube", "Amazon", "Google",
    "Metropolitan", "Museum", "Library", "University", "College", "Hospital", "Church", "Airport", "Station", "National", "International", "Local", "Royal",
    "Walmart", "Target", "Costco", "Student", "Students", "Teacher", "Teachers", "Farmer", "Class", "Children", "People", "Workers", "Company", "Store",
    "School", "Family", "Friends", "Team", "Group", "Member", "Members", "Boy", "Girl", "Boys", "Girls", "Man", "Woman", "Men", "Women", "Brother", "Sister",
    "Mother", "Father", "Uncle", "Aunt", "Son", "Daughter", "Husband", "Wife", "Baby", "Mom", "Dad", "Grandma", "Grandpa", "Grandad", "Grandmother",
    "Grandfather", "Cousin", "Neighbor", "Day", "Week", "Month", "Year", "Hour", "Minute", "Morning", "Afternoon", "Evening", "Night", "Western", "Eastern",
    "Northern", "Southern", "Lego", "Legos", "Scrabble", "Pokemon", "Junior", "Senior", "Little", "Big", "Great", "Christmas", "Easter", "Halloween",
    "Thanksgiving", "First", "Second", "Third", "Fourth", "Fifth", "Last", "Next", "New", "Old", "Once", "Per", "Plus", "Currently", "Originally", "Recently",
    "Finally", "However", "Therefore", "Meanwhile", "Although", "Mr", "Mrs", "Ms", "Dr", "Prof", "Sir",
)


def without_possessive(name: Column) -> Column:
    """'s goes from names of more than three characters; else a single last s does."""
    longer = F.length(name) > 3
    return F.when(longer & name.endswith("'s"), F.regexp_replace(name, "'s$", "")).when(longer & name.endswith("s") & ~name.endswith("ss"), F.regexp_replace(name, "s$", "")).otherwise(name)


def entity_names(docs: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(doc_id, names): capitalised words of two letters or more, without possessives, the first of each spelling; none for a null or empty text.

    Words in capitals only are acronyms if longer than two letters. A word is left out if it or its base is in ``excluded``.
    """
    out = F.array(*map(F.lit, excluded)) if excluded else F.array().cast("array<string>")
    words = F.transform(F.split(F.coalesce("text", F.lit("")), r"[.?!\s]+"), lambda w: F.regexp_replace(w, "[^a-zA-Z']", ""))
    named = F.filter(words, lambda w: F.rlike(w, F.lit("^[A-Z][a-zA-Z']")) & ((F.length(w) <= 2) | (w != F.upper(w))) & ~F.array_contains(out, w))
    bases = docs.select("doc_id", F.filter(F.transform(named, without_possessive), lambda b: ~F.array_contains(out, b)).alias("b"))
    lowered = F.transform("b", lambda x: F.lower(x))
    return bases.select("doc_id", F.filter("b", lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1).alias("names"))


_OUT = ", ".join(f"'{x}'" for x in EXCLUDED)
_NAMES_SQL = f"""with w as (select doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '[.?!\\s]+'), lambda w: regexp_replace(w, '[^a-zA-Z'']', '', 'g')) as w from @documents),
b as (select doc_id, list_filter(list_transform(list_filter(w, lambda w: regexp_matches(w, '^[A-Z][a-zA-Z'']') and (length(w) <= 2 or w <> upper(w)) and w not in ({_OUT})),
  lambda x: case when length(x) > 3 and x like '%''s' then left(x, -2) when length(x) > 3 and x like '%s' and x not like '%ss' then left(x, -1) else x end), lambda x: x not in ({_OUT})) as b from w),
names as (select doc_id, list_filter(b, lambda x, i: list_position(list_transform(b, lambda y: lower(y)), lower(x)) = i) as names from b)
"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_names(views.frame(spark, sf_dir, "documents"))


def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("doc_id", F.size("names").cast("long").alias("n_names"), F.array_join("names", "|").alias("names"))


def entity_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts have 0 to 5 names, or 6 and more, with the least, mean and most of all texts."""
    n = _names(spark, sf_dir).select(F.size("names").cast("long").alias("n"))
    whole = n.agg(F.min("n").alias("least"), F.avg("n").alias("mean"), F.max("n").alias("most"))
    return n.groupBy(F.least("n", F.lit(6)).cast("long").alias("bucket")).agg(F.count("*").alias("n_docs")).crossJoin(F.broadcast(whole))  # one row


def entity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality label of texts with 0, 1, 2, 3 or 4 and more names, its difference from texts without any, and whether there are fewer than 15."""
    labels = views.frame(spark, sf_dir, "labels").select("doc_id", "quality")
    sized = _names(spark, sf_dir).select("doc_id", F.least(F.size("names"), F.lit(4)).cast("long").alias("bucket")).join(labels, "doc_id")
    found = sized.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("quality").alias("accuracy"))
    none = found.agg(F.max(F.when(F.col("bucket") == 0, F.col("accuracy"))).alias("base"))
    return found.crossJoin(F.broadcast(none)).select("bucket", "n", F.round("accuracy", 9).alias("accuracy"), F.round(F.col("accuracy") - F.col("base"), 9).alias("delta"), (F.col("n") < 15).alias("few"))


def entity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality label of texts with no name, one or two, three and more, and whether there are too few texts (below 15) to say."""
    labels = views.frame(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.size("names")
    band = F.when(n == 0, "0").when(n <= 2, "1-2").otherwise("3+")
    sized = _names(spark, sf_dir).select("doc_id", band.alias("band")).join(labels, "doc_id")
    return sized.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 9).alias("accuracy"), (F.count("*") < 15).alias("few"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "entity_extract": (entity_extract, _NAMES_SQL + "select doc_id, cast(len(names) as bigint) as n_names, coalesce(array_to_string(names, '|'), '') as names from names"),
    "entity_hist": (
        entity_hist,
        _NAMES_SQL + """, n as (select cast(len(names) as bigint) as n from names)
select least(n, 6) as bucket, count(*) as n_docs, (select min(n) from n) as least, (select avg(n) from n) as mean, (select max(n) from n) as most from n group by least(n, 6)""",
    ),
    "entity_bands": (
        entity_bands,
        _NAMES_SQL + """select ['0', '1-2', '1-2', '3+'][least(len(names), 3) + 1] as band, count(*) as n, round(avg(quality), 9) as accuracy, count(*) < 15 as few from names join @labels l on l.doc_id = names.doc_id group by 1""",
    ),
    "entity_buckets": (
        entity_buckets,
        _NAMES_SQL + """, f as (select cast(least(len(names), 4) as bigint) as bucket, count(*) as n, avg(quality) as accuracy from names join @labels l on l.doc_id = names.doc_id group by 1)
select bucket, n, round(accuracy, 9) as accuracy, round(accuracy - (select max(accuracy) from f where bucket = 0), 9) as delta, n < 15 as few from f""",
    ),
}
