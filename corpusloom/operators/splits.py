"""Shuffles, exact splits, batches and caps over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import hash_bucket, range_bucket, ranked


def seeded_digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``position`` from 1 in a seeded random order."""
    d = df.withColumn("_digest", seeded_digest(F.col(key), seed))
    return ranked(d, hash_bucket(F.col("_digest")), ["_digest", key], "position").drop("_digest")


def train_val(df: DataFrame, key: str, fraction: float = 0.005, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: exactly max(1, floor(n * fraction)) rows are ``val``."""
    n = df.count()
    val = max(1, int(n * fraction))
    return shuffled(df, key, seed).withColumn("split", F.when(F.col("position") <= val, "val").otherwise("train")).drop("position")


def batched(df: DataFrame, key: str, size: int, drop_last: bool = False) -> DataFrame:
    """``df`` with ``batch_id`` in the order of ``key``."""
    out = ranked(df, range_bucket(df, key), [key], "_rank").withColumn("batch_id", F.floor((F.col("_rank") - 1) / size).cast("long")).drop("_rank")
    return out.where(F.col("batch_id") < df.count() // size) if drop_last else out


def cycled(df: DataFrame, key: str, epochs: int) -> DataFrame:
    """``df`` ``epochs`` times over, with ``epoch`` and the ``position`` in the endless stream from 0."""
    n = df.count()
    out = ranked(df, range_bucket(df, key), [key], "_rank").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return out.withColumn("position", F.col("epoch") * F.lit(n) + F.col("_rank") - 1).drop("_rank")


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def exact_chunks(ids: Column, length: int, pad: int) -> Column:
    """The first ``length`` + 1 ids, padded; what is beyond is left out."""
    from ..functions.sequences import padded

    return padded(ids, length + 1, pad)
