"""The corpus pipeline: STAGES in order, each over all that the one before kept.

Quality rules drop the documents they reject; line dedup cuts repeated chunks and drops documents of which no word is left; the Jaccard join
keeps the document with the smallest doc_id of each group; decontamination drops documents that hold a benchmark item; packing places what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlens.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from rolloutlens.llm.common import NULL_ID, real_id, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORD = r"[^\x20\x09-\x0D]"


def _text_hash() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text the rules keep. Each row is judged by itself, so rows with a null or a repeated doc_id stay or go as their own text says."""
    named = docs.select(*COLUMNS).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("th", _text_hash())
    judged = quality.judge(named, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=("th",)).where("kept").select("doc_id", "th", "stratum").distinct()
    same = named["doc_id"].eqNullSafe(judged["doc_id"]) & (named["th"] == judged["th"]) & (F.coalesce(named["lang"].cast("string"), F.lit("")) == judged["stratum"])
    return named.join(judged, same, "left_semi").select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with repeated passages cut out; rows that lost lines and have no word left go."""
    done = line_dedup.passage_dedup(docs.select(*COLUMNS))
    left = done.where((F.col("n_removed_lines") == 0) | F.rlike("text", F.lit(WORD)))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: of the rows with the group's smallest doc_id the first by text and the other columns. A group of null doc_ids alone keeps one row too; rows without words are linked with nothing and all stay."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), _text_hash().alias("th"), *COLUMNS[1:])
    found = jaccard_join.linked(docs.select(*COLUMNS), with_group=True).where("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("did"), "th")
    firsts = found.groupBy("component").agg(F.min(place).alias("r")).select("r.did", "r.th")
    worded = F.coalesce(F.rlike("text", F.lit(WORD)), F.lit(False))
    kept = rows.where(worded).join(firsts, ["did", "th"]).groupBy("did", "th").agg(F.min(F.struct(*COLUMNS[1:])).alias("r"))
    both = kept.select("did", *[F.col(f"r.{c}").alias(c) for c in COLUMNS[1:]]).unionAll(rows.where(~worded).select("did", *COLUMNS[1:]))
    return both.select(real_id().alias("doc_id"), *COLUMNS[1:])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark item. A row goes with its own text: the text's hash decides beside the doc_id, null or not."""
    rows = docs.select(*COLUMNS).withColumn("th", _text_hash())
    named = rows.select(F.col("th").alias("doc_id"), "text")  # items are looked for in texts, whatever their ids
    hits = decontaminate.contaminated(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("th")).distinct()
    return rows.join(hits, "th", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, as in ``packing.pack``."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", packed),
]
ORACLE_SQL = None  # cut points of rolling hashes and the packing aren't SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
