"""Connected components of a large graph by alternating large and small stars, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloutlens.llm.common import drop_files, written


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, component) for nodes of ``edges`` (a, b), component being the smallest node that can be reached.

    Minima are partial sums by node and the joins back can be split, so a node with very many neighbours needs no task of its own.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("b", "m").union(small.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = written(small, name)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_files(now.sparkSession, now)
        now = after
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = seen
