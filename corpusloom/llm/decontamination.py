"""Benchmark decontamination: short test items found inside long documents.

Size-partitioned MinHash containment search.  Documents are partitioned by the
number of their distinct shingles; a partition has its own number of bins, at
least four for each shingle, and a document's signature is the least hash in
each bin.  An item's signature under the same bins agrees with it in most bins
if the item's shingles lie in the document, however long the rest of it is.
Each pair that agrees anywhere is verified by exact shingle containment.

An item of n shared shingles is missed with a probability of about 0.2 ** n;
items of fewer than ``SMALL`` shingles form a partition whose bins are all hash
values, where nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textarrays import U64, shingle_sets, text_groups

WIDTH, PERCENT = 5, 80
SMALL, BINS_PER_SHINGLE, LEAST_BITS = 16, 4, 6
#: Item shingles that are sent to every task at once (8 bytes each); more are searched for in further passes.
BLOCK_SHINGLES = 2_000_000
FILTER_BITS = 20


def bin_bits(n: int) -> int:
    """Size partition of a document with n distinct shingles, named by the bits of its bin number."""
    return max(LEAST_BITS, (max(n, 1) * BINS_PER_SHINGLE - 1).bit_length())


def signature(sorted_set: np.ndarray, bits: int) -> np.ndarray:
    """The least hash of each bin that has any."""
    least = np.full(1 << bits, -1, np.int64)
    # Of several places written to one bin the last stays, here the smallest hash.
    least[(sorted_set[::-1] & U64((1 << bits) - 1)).astype(np.int64)] = np.arange(len(sorted_set) - 1, -1, -1)
    return sorted_set[least[least >= 0]]


class Lookup:
    """Which items have a hash in their signature."""

    def __init__(self, keys: list[np.ndarray], owners: list[int]):
        values = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner = np.repeat(np.array(owners, np.int64), [len(k) for k in keys]) if keys else np.zeros(0, np.int64)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(values >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def owners(self, hashes: np.ndarray) -> np.ndarray:
        maybe = hashes[self.seen[(hashes >> U64(64 - FILTER_BITS)).astype(np.int64)]]
        if not len(maybe):
            return np.zeros(0, np.int64)
        low, high = np.searchsorted(self.values, maybe, "left"), np.searchsorted(self.values, maybe, "right")
        return np.unique(np.concatenate([self.owner[a:b] for a, b in zip(low, high)] or [np.zeros(0, np.int64)]))


@dataclass
class Index:
    """Items of one shingle width."""

    sets: list[np.ndarray]
    parts: dict[int, Lookup] = field(default_factory=dict)
    small: Lookup | None = None

    def candidates(self, doc: np.ndarray) -> np.ndarray:
        if self.small is None:
            few = [i for i, s in enumerate(self.sets) if len(s) < SMALL]
            self.small = Lookup([self.sets[i] for i in few], few)
        bits = bin_bits(len(doc))
        if bits not in self.parts:
            many = [i for i, s in enumerate(self.sets) if len(s) >= SMALL]
            self.parts[bits] = Lookup([signature(self.sets[i], bits) for i in many], many)
        return np.concatenate([self.small.owners(doc), self.parts[bits].owners(signature(doc, bits))])

    def contained(self, doc: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that the document holds to ``percent``."""
        out = []
        for i in self.candidates(doc).tolist():
            item = self.sets[i]
            at = np.minimum(np.searchsorted(doc, item), len(doc) - 1)
            shared = int((doc[at] == item).sum())
            if 100 * shared >= percent * len(item):
                out.append((i, shared))
        return out


def item_sets(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, width, n, shingles (64-bit hashes) of each item with any word; shorter items have one shingle of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("item_id"), []
            for group in text_groups(batch.column("text")):
                words = group.lower().words()
                counts = np.diff(words.offsets)
                found += [(ids[group.first + i].as_py(), min(WIDTH, int(counts[i])), len(s), s.tobytes()) for i, s in enumerate(shingle_sets(words, WIDTH)) if len(s)]
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["item_id", "width", "n", "shingles"])

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "item_id long, width int, n long, shingles binary")


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """All items, in blocks of about BLOCK_SHINGLES shingles at most."""
    sets = scratch.written(item_sets(items, id_col, text_col), "items")
    total = sets.agg(F.sum("n")).head()[0] or 0
    blocks = -(-total // BLOCK_SHINGLES)
    for b in range(blocks):
        yield sets.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == b).collect()


def _search(block: list, percent: int, batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, int, list[tuple[int, int, int]]]]:
    """For each row its batch, its place there, and (item id, item shingles, shared) of what it contains."""
    by_width: dict[int, tuple[Index, list[int]]] = {}
    for r in block:
        index, ids = by_width.setdefault(r.width, (Index([]), []))
        index.sets.append(np.frombuffer(r.shingles, np.uint64))
        ids.append(r.item_id)
    for batch in batches:
        for group in text_groups(batch.column(text)):
            words = group.lower().words()
            found: list[list] = [[] for _ in range(len(group))]
            for width, (index, ids) in by_width.items():
                for i, doc in enumerate(shingle_sets(words, width)):
                    if len(doc):
                        found[i] += [(ids[k], len(index.sets[k]), shared) for k, shared in index.contained(doc, percent)]
            for i, f in enumerate(found):
                yield batch, group.first + i, f


def contamination(docs: DataFrame, items: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and item of whose distinct shingles the document has ``percent`` or more.

    doc_id, item_id, n_item_shingles, n_shared.  Texts are whole, lower-cased in
    A-Z, in shingles of five words; an item of fewer words has one shingle of all
    of them, looked for anywhere in a document.  Null or empty items and
    documents contain nothing and are contained nowhere; null ids are returned
    as null; repeated rows are returned as often as they occur; other columns
    are ignored; without items or documents the result is empty.
    """
    spark = docs.sparkSession
    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, item_id long, n_item_shingles long, n_shared long"
    passes = []
    for block in item_blocks(items, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for batch, i, found in _search(shared.value, percent, batches, "text"):
                if found:
                    doc_id = batch.column("doc_id")[i].as_py()
                    rows += [(doc_id, *f) for f in found]
                if len(rows) >= 10_000:
                    yield _pairs(rows)
                    rows = []
            yield _pairs(rows)

        passes.append(inner.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], schema)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_item_shingles", "n_shared"])


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that contain an item to ``percent``; no shuffle."""
    spark = docs.sparkSession
    for block in item_blocks(items, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)
        names = docs.columns
        inner = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.coalesce(F.col(text_col), F.lit("")).alias("searched_text"))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, width=len(names)) -> Iterator[pa.RecordBatch]:
            def flush(batch, keep):
                return batch.select(list(range(width))).filter(pa.array(keep))

            last, keep = None, []
            for batch, _, found in _search(shared.value, percent, batches, "searched_text"):
                if batch is not last and last is not None:
                    yield flush(last, keep)
                    keep = []
                last = batch
                keep.append(not found)
            if last is not None:
                yield flush(last, keep)

        schema = ", ".join(f"c{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(names)))
        docs = inner.mapInArrow(run, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
    return docs
