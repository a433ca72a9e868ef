"""Which rows of a large table have an id of a smaller one, told where the rows are: they are not exchanged.

Ids go into a bounded Bloom filter in blocks, which every task gets.  It finds
every id that was put in, and others rarely; what depends on an exact answer
looks these up by their ids alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .buckets import SCHEMA, by_bucket, dealt
from .textarrays import U64, mix

#: Bits of a block (a place in it has 16 bits), bits aimed at for each id, and blocks at most: 16 MB, above 8 million ids others are found more often.
BLOCK_BITS, BITS, MOST_BLOCKS = 1 << 16, 16, 2048
#: So few ids are left to a join, in which Spark sends them to every task itself.
FEW = 1 << 14
#: Ids found by mistake that are sent to every task; more are left to a join.
MISTAKES = 1 << 20
SALT = U64(0xA0761D6478BD642F)


class IdFilter:
    """``bits``: a row of bytes for each block."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Which ids may have been put in: all that were, and some others."""
        first = mix(ids.astype(np.int64).view(U64))
        block, places = (first % U64(len(self.bits))).astype(np.int64), _places(mix(first ^ SALT))
        found = np.ones(len(ids), bool)
        for at in places:
            found &= (self.bits[block, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found


def _places(second: np.ndarray) -> list[np.ndarray]:
    return [(second >> U64(k) & U64(BLOCK_BITS - 1)).astype(np.int64) for k in (0, 16, 32, 48)]


def id_filter(ids: DataFrame, n: int) -> IdFilter:
    """Filter of the longs in the one column of ``ids``, about ``n`` of them, none null."""
    blocks = min(MOST_BLOCKS, -(-max(n, 1) * BITS // BLOCK_BITS))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = mix(np.unique(batch.column(0).to_numpy()).view(U64))
            yield dealt(mix(first ^ SALT), (first % U64(blocks)).astype(np.int64), blocks)

    def put(block: int, second: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOCK_BITS, np.uint8)
        for at in _places(second):
            bits[at] = 1
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bucket", "records"])

    made = by_bucket(ids.mapInArrow(hashed, SCHEMA), np.dtype("<u8"), put, SCHEMA, with_bucket=True).toArrow()
    bits = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for block, raw in zip(made.column(0).to_pylist(), made.column(1)):
        bits[block] = np.frombuffer(raw.as_buffer(), np.uint8)
    return IdFilter(bits)


def likely(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` with one of ``ids`` (one column of longs, none null, repeats do no harm) in ``column``, and perhaps others: for a join that follows.

    ``ids`` is read twice.
    """
    if (n := ids.count()) <= FEW:
        return df
    shared = df.sparkSession.sparkContext.broadcast(id_filter(ids, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(column).cast(pa.int64())
            yield batch.filter(pa.array(shared.value.find(mine.fill_null(0).to_numpy()) & mine.is_valid().to_numpy(zero_copy_only=False)))

    return df.mapInArrow(run, df.schema)


def without(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` with none of ``ids`` (a written table of one column of longs, none null) in ``column``; rows with a null there stay."""
    name = ids.columns[0]
    if not (n := ids.count()):
        return df
    spark = df.sparkSession
    known = df.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias(name))
    made = id_filter(ids, n)
    shared = spark.sparkContext.broadcast(made)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.find(batch.column(0).to_numpy())))

    mistaken = scratch.written(known.mapInArrow(found, f"`{name}` long").join(ids, name, "left_anti").distinct(), "ids-mistaken")
    if mistaken.count() > MISTAKES:
        return df.join(ids.withColumnRenamed(name, "_gone"), F.col(column).cast("long") == F.col("_gone"), "left_anti")
    both = spark.sparkContext.broadcast((made, np.sort(mistaken.toArrow().column(0).to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, right = both.value
        for batch in batches:
            mine = batch.column(column).cast(pa.int64())
            values = mine.fill_null(0).to_numpy()
            gone = mine.is_valid().to_numpy(zero_copy_only=False) & bits.find(values)
            if len(right):
                gone &= right[np.minimum(np.searchsorted(right, values), len(right) - 1)] != values
            yield batch.filter(pa.array(~gone))

    return df.mapInArrow(run, df.schema)
