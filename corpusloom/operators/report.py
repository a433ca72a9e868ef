"""One nested report from one-row tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested(parts: dict[str, DataFrame]) -> DataFrame:
    """A row with a struct for each part; every part has one row."""
    structs = [df.select(F.struct(*df.columns).alias(name)) for name, df in parts.items()]
    return reduce(DataFrame.crossJoin, structs)


def as_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def write(report: DataFrame, path: str) -> None:
    as_json(report).coalesce(1).write.mode("overwrite").text(path)  # one row
