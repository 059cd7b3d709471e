"""Pools drawn from all knob specs, and their texts read back.

The draw has no SQL of its own: ``tests/test_draws.py`` holds it against plain Python. The check's oracle is that every text is read back to its stored gold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlens.functions.recompute import with_recomputed
from rolloutlens.operators import draws


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw for each row of part, the concepts by turns."""
    names = F.array(*[F.lit(c) for c in sorted(draws.RECIPES)])
    ids = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.get(names, (F.col("p_partkey") % len(draws.RECIPES)).cast("int")).alias("concept"))
    return draws.pool_draw(ids, draws.spec_table(spark))


def pool_specs_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knobs and chain as text."""
    knobs = F.concat_ws(" ", F.transform(F.sort_array(F.map_keys("knobs")), lambda k: F.concat(k, F.lit("="), F.col("knobs")[k])))
    chain = F.when(F.col("fed_param").isNotNull(), F.concat(F.concat_ws("+", "components"), F.lit(" "), "fed_param", F.lit("="), "fed_value")).otherwise("-")
    return drawn(spark, sf_dir).select("id", "concept", F.col("turn").cast("long").alias("turn"), "problem", "answer", knobs.alias("knobs"), chain.alias("chain"))


def pool_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By concept: whether every drawn text was read, and whether each gave the stored gold."""
    rows = with_recomputed(drawn(spark, sf_dir).select("id", "concept", "problem", "answer"))
    same = F.coalesce(F.col("exact") == F.col("answer"), F.lit(False))
    return rows.groupBy("concept").agg(F.bool_and(F.col("recomputed").isNotNull()).alias("all_read"), F.bool_and(same).alias("all_equal"))


_READ_BACK_SQL = f"select * from (values {', '.join(f'({chr(39)}{c}{chr(39)}, true, true)' for c in sorted(draws.RECIPES))}) t(concept, all_read, all_equal) where (select count(*) from @part) >= {len(draws.RECIPES)}"

#: Without an oracle: pool_specs_draw.
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {"pool_specs_draw": (pool_specs_draw, None), "pool_read_back": (pool_read_back, _READ_BACK_SQL)}
