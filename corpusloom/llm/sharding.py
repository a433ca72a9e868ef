"""Minimax contiguous sharding: equal texts stay together, shards are as even as they can be.

Atomic groups (equal texts) are ordered by a 64-bit hash of the text.  The
smallest capacity for which a greedy left-to-right fill needs no more than the
wanted shards is found by binary search, and the order is cut there.  Only
DataFrame functions touch rows; the search runs on a histogram of the order
whose size is bounded by ``HISTOGRAM`` and which is refined where cuts can fall.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import zip_longest

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Leading bits of the order key in the first histogram, and at most so many cells of a histogram.
FIRST_BITS, HISTOGRAM = 13, 1 << 17
#: Cells of each shard inside which positions are dealt; rows of a cell are ordered by one task.
CELLS = 512


@dataclass(frozen=True)
class Cell:
    """A stretch of the order: groups whose key's leading ``bits`` equal ``prefix`` (signed)."""

    prefix: int
    bits: int
    size: int
    groups: int
    largest: int

    @property
    def first_key(self) -> int:
        return self.prefix << (64 - self.bits)


def _greedy(cells: list[Cell], capacity: int, shards: int, divisible: bool) -> list[int] | None:
    """First cells of each shard for this capacity, or None if it is too small.

    divisible: a cell of several groups may be cut anywhere, which never needs
    more shards than any real cut; otherwise it stays whole.
    """
    firsts, room = [0], capacity
    for i, c in enumerate(cells):
        if (c.largest if divisible else c.size) > capacity:
            return None
        if c.size <= room:
            room -= c.size
            continue
        rest = c.size
        if divisible and c.groups > 1:
            rest -= room
            more = -(-rest // capacity)
            firsts += [i] * more
            room = more * capacity - rest
        else:
            firsts.append(i)
            room = capacity - rest
        if len(firsts) > shards:
            return None
    return firsts


def _smallest(cells: list[Cell], shards: int, divisible: bool) -> int:
    """Binary search for the smallest capacity that ``_greedy`` accepts."""
    low = max(max((c.largest for c in cells), default=0), -(-sum(c.size for c in cells) // shards))
    high = max(low, sum(c.size for c in cells))
    while low < high:
        mid = (low + high) // 2
        if _greedy(cells, mid, shards, divisible) is not None:
            high = mid
        else:
            low = mid + 1
    return low


def _prefix(bits: int):
    return F.shiftright("order_key", 64 - bits)


def _histogram(groups: DataFrame, bits: int) -> list[Cell]:
    rows = groups.groupBy(_prefix(bits).alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("largest"))
    return sorted((Cell(r.p, bits, r.size, r.n, r.largest) for r in rows.collect()), key=lambda c: c.first_key)


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Order keys at which shards 1, 2, ... begin, for the smallest possible largest shard.

    ``groups`` has ``order_key`` (long) and ``size`` (long), one row a group.
    Each round replaces the cells in which a cut could fall by finer ones, until
    the bounds of the capacity meet; a collected histogram has at most
    ``HISTOGRAM`` cells.
    """
    cells = _histogram(groups, FIRST_BITS)
    if not cells:
        return []
    while True:
        low, high = _smallest(cells, shards, True), _smallest(cells, shards, False)
        near, far = _greedy(cells, low, shards, True), _greedy(cells, high, shards, False)
        if low == high:
            break
        doubtful = set()
        for bounds in zip_longest(_reach(cells, low, shards), _reach(cells, high, shards), near[1:], far[1:]):
            found = [i for i in bounds if i is not None]
            doubtful.update(i for i in range(max(0, min(found) - 1), min(len(cells), max(found) + 2)) if cells[i].groups > 1)
        if not doubtful:
            break
        parts: dict[int, list[int]] = {}
        for i in doubtful:
            parts.setdefault(cells[i].bits, []).append(cells[i].prefix)
        fine: list[Cell] = []
        for bits, prefixes in parts.items():
            deeper = min(64, bits + max(1, (HISTOGRAM // len(doubtful)).bit_length() - 1))
            fine += _histogram(groups.where(_prefix(bits).isin(prefixes)), deeper)
        cells = sorted([c for i, c in enumerate(cells) if i not in doubtful] + fine, key=lambda c: c.first_key)
    return [cells[i].first_key for i in far[1:]]


def _reach(cells: list[Cell], capacity: int, shards: int) -> list[int]:
    """The cell in which the total of j * capacity is reached, for each j."""
    out, total, j = [], 0, 1
    for i, c in enumerate(cells):
        total += c.size
        while j < shards and total >= j * capacity:
            out.append(i)
            j += 1
    return out + [len(cells) - 1] * (shards - 1 - len(out))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents into ``shards`` contiguous shards of near-equal bytes.

    Returns one row per input row: doc_id, size (UTF-8 bytes plus 8),
    text_crc32, law (``bytes``), shard, slot (gapless from 0 in its shard) and
    grown_shard (null under this law).  A null text counts as empty, so null and
    empty texts form one group; null ids and repeated rows are rows like any
    other and get slots of their own; other columns are ignored; an empty table
    gives an empty result.  A group larger than the mean shard makes a shard
    larger than the mean, since groups are never split.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("order_key"),
        ),
        "shard-rows",
    )
    cuts = minimax_cuts(rows.groupBy("order_key").agg(F.sum("size").alias("size")), shards)
    shard = F.lit(0)
    for key in cuts:
        shard = shard + (F.col("order_key") >= F.lit(key)).cast("int")
    rows = rows.withColumn("shard", shard).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(CELLS)).cast("int"))
    # shards * CELLS rows at most, whatever the input: small enough to broadcast.
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("inside", inside)
        .join(F.broadcast(base), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
