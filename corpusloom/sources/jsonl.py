"""Readers and writers of line-based corpora."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.extract import has_key


def read_lines(spark: SparkSession, path: str, shared: str | None = None) -> DataFrame:
    """Every line, blank and broken ones too: value, file, line (a number that grows along file name and place).

    Numbers hold within one read; where a later step orders by them, give a
    ``shared`` folder and the numbered lines are written there first.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("_id"))
    files = lines.select("file").distinct()
    if shared:
        lines.write.mode("overwrite").parquet(shared)
        lines = spark.read.parquet(shared)
        files = lines.select("file").distinct()
    from pyspark.sql import Window

    order = files.withColumn("_f", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("file")))
    return lines.join(order, "file").select("value", "file", F.struct("_f", "_id").alias("line"))


def prompts(lines: DataFrame) -> DataFrame:
    """prompt and category of records that have a prompt key, one record a line; brackets and commas around a record go.

    For files that are one array in another layout see :func:`read_prompts`.
    """
    record = F.regexp_replace(F.regexp_replace("value", r"\A\s*\[?\s*(?=\{)", ""), r"(?<=\})\s*,?\s*\]?\s*\z", "")
    return lines.select(record.alias("j")).where(has_key(F.col("j"), "prompt")).select(F.get_json_object("j", "$.prompt").alias("prompt"), F.get_json_object("j", "$.category").alias("category"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """prompt and category of the records with a prompt key in files that hold one JSON array each, in any layout, or one record a line.

    A file is read whole, by one task.  An array that is broken gives no rows.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\A[\uFEFF\s]+", "").alias("value"))
    is_array = F.col("value").startswith("[")
    records = F.when(is_array, F.from_json("value", "array<string>")).otherwise(F.split("value", r"\r?\n"))
    return prompts(files.select(F.explode(records).alias("value")))


def corpus_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a prepared corpus, one text a line; blank lines go.  A path without files raises FileNotFoundError."""
    try:
        return spark.read.text(path).select(F.col("value").alias("text")).where(T.strip(F.col("text")) != "")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(path) from e


def plain_prompts(lines: DataFrame) -> DataFrame:
    return lines.select(T.strip(F.col("value")).alias("prompt")).where("prompt != ''")


def peek(lines: DataFrame, order: str = "line", n: int = 3, chars: int = 300) -> DataFrame:
    """Keys and the beginning of the first records."""
    first = lines.orderBy(order).limit(n)
    return first.select(order, F.json_object_keys("value").alias("keys"), F.substring("value", 1, chars).alias("head"))


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, nulls among its values; text is written as it is."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
