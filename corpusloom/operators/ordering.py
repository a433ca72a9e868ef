"""Ranks and running values over a whole table without gathering it in one task.

Rows are dealt into ordered buckets of the key.  Totals of the buckets, a
bounded number, are accumulated; inside a bucket a window does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def hash_bucket(digest: Column) -> Column:
    """Bucket of a hexadecimal digest by its first three digits, in the digest's order."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def range_bucket(df: DataFrame, key: str, buckets: int = BUCKETS) -> Column:
    """Bucket of a number by the table's quantiles, so that buckets are about even however far apart the numbers lie."""
    edges = sorted(set(df.approxQuantile(key, [k / buckets for k in range(1, buckets)], 0.5 / buckets)))
    if not edges:
        return F.lit(0)
    known = F.split(F.lit(",".join(map(repr, edges))), ",").cast("array<double>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))))
    # A binary search: how many edges are not above the number.
    further = lambda place, step: F.when(F.coalesce(F.get(known, place + step - 1) <= F.col(key), F.lit(False)), place + step).otherwise(place)
    return F.aggregate(steps, F.lit(0), further)


def ranked(df: DataFrame, bucket: Column, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with its row number from 1 in the order of (bucket, *order)."""
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    # One row a bucket, BUCKETS at most: fit to broadcast.
    return rows.withColumn("_inside", inside).join(F.broadcast(base), "_bucket").withColumn(name, (F.col("_base") + F.col("_inside")).cast("long")).drop("_bucket", "_base", "_inside")


def running(df: DataFrame, key: str, sums: dict[str, str] | None = None, minima: dict[str, str] | None = None) -> DataFrame:
    """``df`` with running sums and minima (name to column) in the order of ``key``."""
    sums, minima = sums or {}, minima or {}
    rows = df.withColumn("_bucket", range_bucket(df, key))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_bucket").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()), *(F.min(c).alias(f"_m_{n}") for n, c in minima.items()))
    base = totals.select("_bucket", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums), *(F.min(f"_m_{n}").over(before).alias(f"_m_{n}") for n in minima))
    inside = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(F.broadcast(base), "_bucket")
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(inside) + F.col(f"_s_{n}"))
    for n, c in minima.items():
        out = out.withColumn(n, F.least(F.min(c).over(inside), F.col(f"_m_{n}")))
    return out.select(*df.columns, *sums, *minima)
