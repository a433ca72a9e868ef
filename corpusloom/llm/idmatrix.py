"""Packed id matrices by best-fit decreasing.

Each task packs what it has read, in rounds of bounded size: documents longer
than a row are split without loss, pieces are placed longest first into the
fullest row that still takes them (a segment tree over remaining capacities
finds it), and rows are written with the cumulative lengths of their segments
and with positions that start anew at each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tokens import encoded_batches

ROW = 2048
#: Tokens that a task gathers before it packs them; memory is about ten bytes a token.
ROUND_TOKENS = 6_000_000
OUT_ROWS = 512
PAD_ID = 0


class Capacities:
    """Open rows by remaining capacity, with a segment tree that finds the tightest fit."""

    def __init__(self, most: int):
        self.leaves = 1 << (most + 1 - 1).bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, row: int, capacity: int) -> None:
        if capacity == 0:
            return
        self.rows[capacity].append(row)
        node = self.leaves + capacity
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row of the least capacity that is at least ``need``, removed, and its capacity."""
        node, filled = self.leaves + need, self.filled
        while not filled[node]:
            while node & 1:  # a right child: go up past its subtree
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # past the last leaf of this level
                return None
        while node < self.leaves:
            node = 2 * node + (not filled[2 * node])
        capacity = node - self.leaves
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            filled[node] = 0
            while node > 1 and not filled[node ^ 1]:
                node >>= 1
                filled[node] = 0
        return row, capacity


def best_fit(lengths: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Row of each piece, its offset there, and the number of rows; no piece is longer than ``row``."""
    open_rows, rows = Capacities(row), 0
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = open_rows.take(n) if n < row else None
        if found is None:
            found = (rows, row)
            rows += 1
        place[i], offset[i] = found[0], row - found[1]
        open_rows.add(found[0], found[1] - n)
    return place, offset, rows


def positions(cu_seqlens: np.ndarray, row: int) -> np.ndarray:
    """0, 1, 2, ... from the start of each segment, and of the padding."""
    starts = np.unique(np.asarray(cu_seqlens))
    return np.arange(row) - starts[np.searchsorted(starts, np.arange(row), "right") - 1]


def _pack_round(doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray, row: int, first: int) -> Iterator[pa.RecordBatch]:
    n = np.diff(offsets)
    each = -(-n // row)
    doc = np.repeat(np.arange(len(n)), each)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * row
    length = np.minimum(n[doc] - start, row)
    place, offset, rows = best_fit(length, row)
    order = np.lexsort((offset, place))
    bounds = np.searchsorted(place[order], np.arange(rows + 1))
    for low in range(0, rows, OUT_ROWS):
        high = min(rows, low + OUT_ROWS)
        part = order[bounds[low] : bounds[high]]
        matrix = np.full((high - low) * row, PAD_ID, "<u4")
        to = (place[part] - low) * row + offset[part]
        total = int(length[part].sum())
        run = np.arange(total) - np.repeat(np.cumsum(length[part]) - length[part], length[part])
        matrix[np.repeat(to, length[part]) + run] = ids[np.repeat(offsets[doc[part]] + start[part], length[part]) + run]
        segments = bounds[low : high + 1] - bounds[low]
        ends = offset[part] + length[part]
        cu = [np.r_[0, ends[a:b]].astype(np.int32) for a, b in zip(segments[:-1], segments[1:])]
        list_offsets = pa.array(segments.astype(np.int32))
        as_list = lambda values: pa.ListArray.from_arrays(list_offsets, values)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(first + low, first + high)),
                pa.array([r.tobytes() for r in matrix.reshape(-1, row)], pa.binary()),
                pa.array(cu, pa.list_(pa.int32())),
                pa.array([positions(c, row).astype("<u4").tobytes() for c in cu], pa.binary()),
                as_list(doc_ids.take(pa.array(doc[part]))),
                as_list(pa.array(start[part])),
                as_list(pa.array(n[doc[part]])),
            ],
            names=["sequence_id", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts", "doc_tokens"],
        )


def id_matrix(docs: DataFrame, row: int = ROW, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", round_tokens: int = ROUND_TOKENS) -> DataFrame:
    """Rows of the packed matrix, lazily: write them where they shall stay.

    sequence_id (partition * 2**32 + row there), ids and position_ids (``row``
    little-endian unsigned 32-bit numbers each), cu_seqlens (0 and the end of
    each segment; padding follows the last), and by segment doc_ids, starts (of
    the segment in its document) and doc_tokens.  A null text is empty and has
    the end id alone; null and repeated ids are packed like others; other
    columns are ignored.
    """
    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, tokens = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, held, tokens
            ids = np.concatenate([h[1] for h in held])
            n = np.concatenate([np.diff(h[2]) for h in held])
            doc_ids = pa.concat_arrays([h[0] for h in held])
            held, tokens = [], 0
            for out in _pack_round(doc_ids, ids, np.r_[0, np.cumsum(n)], row, first):
                yield out
                first = int(out.column("sequence_id")[-1].as_py()) + 1

        for rows, ids, offsets in encoded_batches(batches, tokenizer):
            held.append((rows.column("doc_id"), ids, offsets))
            tokens += len(ids)
            if tokens >= round_tokens:
                yield from flush()
        if held:
            yield from flush()

    return inner.mapInArrow(run, "sequence_id long, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>, doc_tokens array<long>")


def digest(matrix: DataFrame) -> DataFrame:
    """A row per piece of a written matrix: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, position_reset (it starts at position 0)."""
    each = matrix.select("sequence_id", "ids", "cu_seqlens", "position_ids", F.posexplode(F.arrays_zip("doc_ids", "starts", "doc_tokens")).alias("i", "s"))
    begin, end = F.element_at("cu_seqlens", F.col("i") + 1), F.element_at("cu_seqlens", F.col("i") + 2)
    return each.select(
        F.col("s.doc_ids").alias("doc_id"),
        F.col("s.starts").alias("start"),
        (end - begin).cast("long").alias("length"),
        F.crc32(F.substring("ids", begin * 4 + 1, (end - begin) * 4)).alias("ids_crc32"),
        F.col("s.doc_tokens").alias("doc_tokens"),
        "sequence_id",
        begin.cast("long").alias("offset"),
        (F.substring("position_ids", begin * 4 + 1, F.lit(4)) == F.lit(b"\0\0\0\0")).alias("position_reset"),
    )


def write_and_digest(docs: DataFrame, row: int = ROW, tokenizer: str | None = None) -> DataFrame:
    """Write the matrix of all documents below the shared folder, read it back and describe each piece."""
    return digest(scratch.written(id_matrix(docs, row, tokenizer), "id-matrix"))
