"""Compact records exchanged between tasks: fixed-size binary records grouped into numbered buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "bucket int, records binary"


def how_many(spark: SparkSession) -> int:
    """Buckets grow with the shuffle partitions that the cluster sets for its input; several make partitions even."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(records: np.ndarray, bucket: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket that has records."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")  # 16 bits: a radix sort
    records, bucket = records[order], bucket[order]
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    raw = records.tobytes()
    size = records.dtype.itemsize
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([raw[cut[b] * size : cut[b + 1] * size] for b in full.tolist()], pa.binary())], names=["bucket", "records"])


def by_bucket(df: DataFrame, kind: np.dtype, handle: Callable[..., Iterator[pa.RecordBatch]], schema: str, with_bucket: bool = False) -> DataFrame:
    """``handle`` applied to all records of each bucket (after the bucket itself, ``with_bucket``); a task holds one bucket at a time."""
    spark = df.sparkSession

    def whole(bucket: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        records = np.concatenate(held)
        return handle(bucket, records) if with_bucket else handle(records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != at and held:
                    yield from whole(at, held)
                    held = []
                at = b
                held.append(np.frombuffer(raw.as_buffer(), kind))
        if held:
            yield from whole(at, held)

    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)
