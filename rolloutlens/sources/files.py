"""File sources and sinks: JSON lines, JSON arrays of rows, Parquet and CSV, each with a fixed schema."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one JSON array file line when a table is written as arrays.
ARRAY_ROWS = 1000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share. A session that names none gets a temporary folder if it runs in one process; on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="rolloutlens-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_path(spark: SparkSession, path: str) -> str | None:
    """A path's place in the file system of the machines, which must be one that they share as for Spark's own files; None if the path belongs to another file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(at).toUri().getPath() if system.getUri().getScheme() == "file" else None


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, missing keys are null."""
    return spark.read.schema(schema).json(path)


def read_json_arrays(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that each hold one JSON array of rows."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def write_json_arrays(df: DataFrame, path: str, order: str) -> None:
    """One array a file, of the rows whose ``order`` (a whole number) falls in the same run of ARRAY_ROWS."""
    row = F.struct(*df.columns)
    chunks = df.groupBy(F.floor(F.col(order) / ARRAY_ROWS).alias("chunk")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), row.alias("row")))).getField("row")).alias("value"))
    chunks.select("value").write.option("maxRecordsPerFile", 1).text(path)


_CSV = {"header": "true", "escape": '"', "multiLine": "true", "nullValue": "\\N", "emptyValue": "", "lineSep": "\n", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str) -> None:
    """Quotes inside a value are doubled, line feeds stay, and a null is \\N."""
    df.write.options(**{k: v for k, v in _CSV.items() if k != "multiLine"}, quoteAll="true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV).csv(path)


#: The ends of a text and of its name in a file of named texts.
_TEXT_END, _NAME_END = "\x02", "\x03"


def write_named_texts(texts: DataFrame, path: str) -> None:
    """(file, text) as text files, each of many texts with their names before them: a folder for each text would make as many files as there are texts. The mark of a text's end is left out of texts."""
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(_TEXT_END), F.lit(""))
    texts.select(F.concat(F.coalesce(F.url_encode("file"), F.lit("")), F.lit(_NAME_END), plain).alias("value")).write.option("lineSep", _TEXT_END).text(path)


def read_named_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of ``write_named_texts``, each text whole with its line ends; a name that was null is null again."""
    at = F.instr("value", _NAME_END)
    name, text = F.expr("substr(value, 1, at - 1)"), F.expr("substr(value, at + 1)")
    return spark.read.option("lineSep", _TEXT_END).text(path).withColumn("at", at).select(F.url_decode(F.nullif(name, F.lit(""))).alias("file"), text.alias("text"))


def read_columnar(tables: DataFrame) -> DataFrame:
    """(version, row_no, cells) from rows (name, columns array, data array of arrays); versions sort as numbers, non-numeric ones as 0."""
    version = F.coalesce(F.regexp_extract("name", r"v([0-9]+)", 1).try_cast("int"), F.lit(0))
    return tables.select(version.alias("version"), "columns", F.posexplode("data").alias("row_no", "row")).select("version", "row_no", F.map_from_arrays("columns", "row").alias("cells"))


def round_trip(df: DataFrame, form: str) -> DataFrame:
    """``df`` written in a form (jsonl, json_array, csv, parquet) and read back with its own schema."""
    spark, path = df.sparkSession, scratch(df.sparkSession, form)
    if form == "jsonl":
        write_jsonl(df, path)
        return read_jsonl(spark, path, df.schema)
    if form == "json_array":
        write_json_arrays(df, path, df.columns[0])
        return read_json_arrays(spark, path, df.schema)
    if form == "csv":
        write_csv(df, path)
        return read_csv(spark, path, df.schema)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
