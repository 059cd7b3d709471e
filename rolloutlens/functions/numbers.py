"""Tables of numbers that Spark makes and joins: primes, prime powers, the smallest numbers with so many divisors, counts of right triangles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolloutlens.functions import exact

#: Numbers up to here are factored by the joined primes (at most 78,498 rows, which is what may be broadcast).
MOST_FACTORED = 10**12
#: Hypotenuses up to here are counted by a table.
MOST_TABLED = 10**7
_POWERS = "array<struct<p: bigint, e: int>>"


def primes(spark: SparkSession, limit: int) -> DataFrame:
    """(p) up to ``limit``: what is no multiple of a smaller number."""
    limit = max(4, limit)
    multiples = spark.range(2, math.isqrt(limit) + 1).select(F.explode(F.sequence(F.col("id") * F.col("id"), F.lit(limit), F.col("id"))).alias("p"), F.lit(1).alias("m"))
    return spark.range(2, limit + 1).select(F.col("id").alias("p"), F.lit(0).alias("m")).union(multiples).groupBy("p").agg(F.max("m").alias("m")).where("m = 0").select("p")


def factored(numbers: DataFrame, largest: int | None = None) -> DataFrame:
    """(n, powers) for the distinct n of ``numbers`` (n) from 1 to MOST_FACTORED: primes up to the square root of the largest n are joined, exponents come from divisibility by their powers,
    and what remains of n is a prime of its own. Null and other n are left out. ``largest`` saves a look for the largest n.
    """
    distinct = numbers.where(F.col("n").between(1, MOST_FACTORED)).select("n").distinct()
    largest = largest or distinct.agg(F.max("n")).first()[0] or 1
    small = F.broadcast(primes(numbers.sparkSession, math.isqrt(largest)))
    # the exponent: how many powers of p divide n, up to the 40 that fit
    exponent = F.expr("cast(size(filter(sequence(1, 40), k -> pow(double(p), k) <= n and n % cast(pow(double(p), k) as bigint) = 0)) as int)")
    divided = distinct.join(small, (F.col("p") * F.col("p") <= F.col("n")) & (F.col("n") % F.col("p") == 0)).select("n", "p", exponent.alias("e"))
    lists = divided.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("p", "e"))).alias("powers"))  # at most 11 primes a number
    all_ = distinct.join(lists, "n", "left").withColumn("powers", F.coalesce("powers", F.array().cast(_POWERS)))
    rest = F.expr("n div aggregate(powers, 1L, (s, x) -> s * cast(pow(double(x.p), x.e) as bigint))")
    own = F.when(rest > 1, F.array(F.struct(rest.alias("p"), F.lit(1).alias("e")))).otherwise(F.array().cast(_POWERS))
    return all_.select("n", F.concat("powers", own.cast(_POWERS)).alias("powers"))


def divisors(powers: str) -> str:
    """All divisors from the prime powers, as a SQL expression of an array."""
    return f"aggregate({powers}, array(1L), (all, x) -> flatten(transform(sequence(0, x.e), k -> transform(all, d -> d * cast(pow(double(x.p), k) as bigint)))))"


def by_divisors(counts: DataFrame) -> DataFrame:
    """(n_divisors, smallest, powers, squares, reason) for the distinct n_divisors of ``counts``, each worked out by itself (``exact.fewest``).

    smallest is the smallest number with so many divisors and squares the sum of squares of the three smallest above 1, both as digits; powers those of smallest, where 64 bits hold it.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d in batch["n_divisors"].tolist():
                try:
                    found = exact.fewest(d)
                except exact.TooLarge:
                    rows.append((d, None, None, None, "too_large"))
                    continue
                smallest, powers = (1, {}) if d == 1 else found[0] if found else (None, None)
                squares = sum(n * n for n, _ in found) if found else None
                text = lambda n: str(n) if n is not None and n.bit_length() <= exact.MOST_BITS else None
                listed = [{"p": p, "e": e} for p, e in sorted(powers.items())] if smallest is not None and smallest < 2**63 else None
                rows.append((d, text(smallest), listed, text(squares), "domain" if smallest is None else None if text(smallest) else "too_large"))
            yield pd.DataFrame(rows, columns=["n_divisors", "smallest", "powers", "squares", "reason"])

    return counts.where("n_divisors is not null").select("n_divisors").distinct().mapInPandas(search, f"n_divisors long, smallest string, powers {_POWERS}, squares string, reason string")


def right_triangles(spark: SparkSession, limit: int) -> DataFrame:
    """(c, triangles): the right triangles with whole sides and a hypotenuse of at most c, for every c up to ``limit``.

    Primitive ones come from their generators m > n > 0 without a common divisor and not both odd; multiples of their hypotenuses are counted, and the counts are added up in blocks of 1024.
    """
    rows = spark.range(2, math.isqrt(max(4, limit)) + 1).withColumnRenamed("id", "m")
    pairs = rows.select("m", F.explode(F.sequence(1 + F.col("m") % 2, F.col("m") - 1, F.lit(2).cast("long"))).alias("n")).withColumn("h", F.expr("m * m + n * n")).where(F.col("h") <= limit)
    common = gcd_sql("m", "n")
    primitive = pairs.where(F.expr(f"{common} = 1")).groupBy("h").agg(F.count("*").alias("k"))
    counts = primitive.select(F.explode(F.sequence("h", F.lit(limit).cast("long"), "h")).alias("c"), "k")
    every = spark.range(limit + 1).select(F.col("id").alias("c"), F.lit(0).cast("long").alias("k")).union(counts).groupBy("c").agg(F.sum("k").alias("k")).withColumn("block", F.expr("c div 1024"))
    blocks = every.groupBy("block").agg(F.sum("k").alias("k")).select("block", (F.sum("k").over(Window.orderBy("block")) - F.col("k")).alias("before"))  # at most MOST_TABLED / 1024 rows
    within = every.withColumn("w", F.sum("k").over(Window.partitionBy("block").orderBy("c")))
    return within.join(blocks, "block").select("c", (F.col("w") + F.col("before")).alias("triangles"))


def gcd_sql(a: str, b: str) -> str:
    """The greatest common divisor of two numbers of 64 bits, by Euclid's steps, which are at most 92."""
    return f"aggregate(sequence(1, 92), named_struct('a', abs({a}), 'b', abs({b})), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)"


def power_sql(a: str, b: str, m: str) -> str:
    """a^b mod m by squaring, for 0 <= a and b and 0 < m below 3 x 10^9."""
    step = "named_struct('r', if(shiftright(s.b, i) & 1L = 1, s.r * s.p % s.m, s.r), 'p', s.p * s.p % s.m, 'b', s.b, 'm', s.m)"
    return f"aggregate(sequence(0, 62), named_struct('r', 1L % ({m}), 'p', ({a}) % ({m}), 'b', cast({b} as bigint), 'm', ({m})), (s, i) -> {step}, s -> s.r)"
