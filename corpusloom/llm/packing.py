"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens.  In every window each queue earns its share of
the window, and its deficit is what it has earned and not been served.  The
round-robin serves tokens one by one to the queue that is furthest behind (the
least virtual time (served + 1/2) / rate, ties to the lower queue; the rate is
the queue's length unless weights are given), so deficits stay below one token
or so and are carried from window to window.

Where there are more sources than fit one array, groups of sources are the
queues, and what a group is served goes to its sources by a round-robin of the
same kind.

The state at the start of any window has a closed form up to a few steps, so
every task starts at its own windows with the deficits that all the windows
before, in other partitions, have left.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .tokens import token_table

WINDOW = 2048
#: Up to so many sources are queues of one round-robin; more are hashed into so many groups, each with its own round-robin.
QUEUES = 256
#: Rows of (partition, source) offsets up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Entries of a block of states, and bytes of blocks that a task keeps.
BLOCK, KEPT_BYTES = 1 << 15, 64 << 20


class Schedule:
    """How many tokens of each queue all windows before a given one hold."""

    def __init__(self, totals: np.ndarray, window: int = WINDOW, rates: np.ndarray | None = None):
        self.totals, self.window = np.asarray(totals, np.int64), window
        self.rates = self.totals.astype(float) if rates is None else np.asarray(rates, float)
        self.all = int(self.totals.sum())
        self.windows = -(-self.all // window)
        # All tokens served by a time, but for rounding: linear between the times at which queues run out.
        ends, at = np.unique(self.totals / self.rates, return_inverse=True) if len(self.totals) else (np.zeros(0), np.zeros(0, np.int64))
        gone, slower = np.bincount(at, self.totals, len(ends)).cumsum(), np.bincount(at, self.rates, len(ends))
        self.times = np.r_[0.0, ends]
        self.flow = np.maximum.accumulate(np.r_[0.0, gone + (slower.sum() - slower.cumsum()) * ends])

    def at(self, tokens: np.ndarray) -> np.ndarray:
        """[len(tokens), queues] tokens served when so many of all have been."""
        k, x = len(self.totals), np.minimum(np.asarray(tokens, np.int64), self.all)
        # Rounding moves the sum by half a token a queue, so the state lies between these two; the tokens between are put in order.
        low, high = (np.clip(np.ceil(self.rates * np.interp(x + d, self.flow, self.times)[:, None] - 0.5), 0, self.totals).astype(np.int64) for d in (-(k / 2 + 2), k / 2 + 2))
        more = (high - low).ravel()
        cell = np.repeat(np.arange(len(more)), more)
        row, queue = np.divmod(cell, max(k, 1))
        token = low.ravel()[cell] + np.arange(len(cell)) - np.repeat(more.cumsum() - more, more)
        order = np.lexsort(((token + 0.5) / self.rates[queue], row))
        first = np.searchsorted(row, np.arange(len(x)))
        taken = order[np.arange(len(cell)) - first[row] < (x - low.sum(1))[row]]
        return low + np.bincount(cell[taken], minlength=low.size).reshape(low.shape)

    def served(self, windows: np.ndarray) -> np.ndarray:
        """[len(windows), queues] tokens served before each window."""
        return self.at(np.asarray(windows, np.int64) * self.window)

    def around(self, queue: int, first: int, last: int) -> tuple[int, int]:
        """Numbers of all tokens served, safely before a queue's first token and after its last."""
        a, b = np.interp((np.array([first, last]) + 0.5) / self.rates[queue], self.times, self.flow)
        slack = 2 * len(self.totals) + 4
        return max(0, int(a) - slack), min(self.all, int(b) + slack)


class Mixture:
    """The windows of sources in groups: ``groups`` has the totals of each group's sources, ``rates`` of a group by its number."""

    def __init__(self, groups: list[np.ndarray], window: int = WINDOW, rates: np.ndarray | None = None):
        self.outer = Schedule(np.array([g.sum() for g in groups], np.int64), window, rates)
        self.groups = groups
        self.clear()

    def clear(self) -> None:
        self.inner: dict[int, Schedule] = {}
        self.kept: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()
        self.bytes = 0

    def __getstate__(self) -> dict:
        self.clear()
        return self.__dict__

    def _inner(self, group: int) -> Schedule:
        if group not in self.inner:
            self.inner[group] = Schedule(self.groups[group], self.outer.window)
        return self.inner[group]

    def _block(self, group: int, size: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """States from window b * size on, and in each window the tokens of the queues before each; group -1: of the groups."""
        if (group, b) in self.kept:
            self.kept.move_to_end((group, b))
            return self.kept[group, b]
        windows = np.arange(b * size, min((b + 1) * size, self.outer.windows) + 1)
        state = self.outer.served(windows) if group < 0 else self._inner(group).at(self._columns(group, int(windows[0]), int(windows[-1]))[0])
        held = np.diff(state, axis=0)
        self.kept[group, b] = state, held.cumsum(1) - held
        self.bytes += 2 * state.nbytes
        while self.bytes > KEPT_BYTES and len(self.kept) > 1:
            self.bytes -= 2 * self.kept.popitem(last=False)[1][0].nbytes
        return state, held.cumsum(1) - held

    def _columns(self, queue: int, low: int, high: int, group: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Of a queue, the tokens served before windows low to high, and the tokens before it within windows low to high - 1."""
        size = max(16, BLOCK // len(self.groups if group < 0 else self.groups[group]))
        mine, ahead = [], []
        for b in range(low // size, (high - 1) // size + 1):
            state, before = self._block(group, size, b)
            cut = slice(max(0, low - b * size), min(size, high - b * size))
            mine.append(state[cut, queue])
            ahead.append(before[cut, queue])
            last = state[cut.stop, queue]
        return np.r_[(*mine, last)], np.concatenate(ahead)

    def pieces(self, group: int, number: int, first: int, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut adjacent documents of a source, the first at token ``first``, at the windows.

        Returns document index, start in the document, length, window and offset in the window.
        """
        ends = first + np.cumsum(lengths)
        low, high = first, int(ends[-1])
        if len(self.groups[group]) > 1:
            low, high = self._inner(group).around(number, low, high)
        low, high = self.outer.around(group, low, high)
        low, high = low // self.outer.window, min(self.outer.windows, high // self.outer.window + 1)
        low = min(low, high - 1)
        mine, ahead = self._columns(group, low, high)
        if len(self.groups[group]) > 1:
            mine, within = self._columns(number, low, high, group)
            ahead = ahead + within
        starts = ends - lengths
        inside = mine[(mine > first) & (mine < ends[-1])]
        cuts = np.unique(np.concatenate([starts, inside, ends[-1:]]))
        begin, length = cuts[:-1], np.diff(cuts)
        doc = np.searchsorted(starts, begin, "right") - 1
        w = np.searchsorted(mine, begin, "right") - 1
        return doc, begin - starts[doc], length, w + low, ahead[w] + begin - mine[w]


def _numbered(sources: DataFrame, queues: int, weights: Mapping[str | None, float]) -> tuple[DataFrame, list[np.ndarray], np.ndarray | None]:
    """``sources`` (key, n) with group and number in the group, the totals of groups, and their rates where weights are given.

    A source with a weight is a group of its own, and so is each other source if all fit ``queues``.
    """
    named = sorted({"" if s is None else f"={s}" for s in weights})
    given = {"" if s is None else f"={s}": float(w) for s, w in weights.items()}
    is_named = F.col("key").isin(named) if named else F.lit(False)
    room = max(1, queues - len(named))
    if sources.count() <= queues:
        group = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key")) - 1  # at most ``queues`` rows
    else:
        own = F.coalesce(F.array_position(F.array(*map(F.lit, named)), F.col("key")).cast("int"), F.lit(0)) if named else F.lit(0)
        group = F.when(is_named, own - 1).otherwise(len(named) + F.pmod(F.xxhash64("key"), F.lit(room)).cast("int"))
    numbers = F.row_number().over(Window.partitionBy("group").orderBy("key")) - 1
    table = scratch.written(sources.withColumn("group", group.cast("int")).withColumn("number", numbers), "packing-sources")
    # Two numbers a source reach the driver and the tasks: 8 bytes of them stay.
    found = table.select("group", "number", "n", F.when(is_named, F.col("key")).alias("key")).toArrow().sort_by([("group", "ascending"), ("number", "ascending")])
    g, n = found["group"].to_numpy(), found["n"].to_numpy()
    # Empty groups keep no place.
    used, at = np.unique(g, return_inverse=True)
    groups = np.split(n, np.flatnonzero(np.diff(g)) + 1) if len(n) else []
    place = dict(zip(used.tolist(), range(len(used))))
    if list(place) != list(place.values()):
        table = table.withColumn("group", F.create_map(*(F.lit(x) for pair in place.items() for x in pair))[F.col("group")])
    if not weights:
        return table, groups, None
    weight = np.full(len(groups), np.nan)
    for i, key in zip(at.tolist(), found["key"].to_pylist()):
        if key is not None:
            weight[i] = given[key]
    totals, rest = np.array([x.sum() for x in groups], float), np.isnan(weight)
    left = 1 - weight[~rest].sum()
    if rest.any():
        if left <= 0:
            raise ValueError("weights of 1 and more leave nothing to the sources without one")
        weight[rest] = left * totals[rest] / totals[rest].sum()
    return table, groups, weight


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, queues: int = QUEUES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """Pack all documents into windows that hold every source in its share of all tokens.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id (the window), offset.  Every window but the last is full.  A null
    text is empty and has the end id alone; null sources form one queue; null and
    repeated ids are packed like others; other columns are ignored.  ``weights``
    are the shares (above 0) that some or all sources shall have of a window
    while they last; the other sources share the rest by their tokens.
    """
    weights = weights or {}
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be above 0")
    table = scratch.written(token_table(docs, tokenizer, id_col, text_col, source_col), "packing-tokens")
    parts = scratch.written(table.groupBy("pid", "key").agg(F.sum("n").alias("n")), "packing-parts")
    sources, groups, rates = _numbered(parts.groupBy("key").agg(F.sum("n").alias("n")), queues, weights)
    mixture = Mixture(groups, window, rates)
    before = Window.partitionBy("key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("pid", "key", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(sources.select("key", "group", "number"), "key")
    if parts.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group, number, n, first = (batch.column(c).to_numpy() for c in ("group", "number", "n", "first"))
            order = np.lexsort((first, number, group))
            # Documents that follow each other in a queue are cut together.
            fresh = np.flatnonzero(np.r_[True, (group[order][1:] != group[order][:-1]) | (number[order][1:] != number[order][:-1]) | (first[order][1:] != (first + n)[order][:-1])])
            wide = batch.column("wide").to_numpy(zero_copy_only=False)
            blobs = batch.column("ids")
            for rows in np.split(order, fresh[1:]):
                doc, start, length, w, offset = mixture.pieces(int(group[rows[0]]), int(number[rows[0]]), int(first[rows[0]]), n[rows])
                crc = np.empty(len(doc), np.int64)
                ids, at = None, -1
                for i, (d, s, m) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist())):
                    if d != at:
                        ids, at = np.frombuffer(blobs[int(rows[d])].as_buffer(), "<u4" if wide[rows[d]] else "<u2").astype("<u4"), d
                    crc[i] = zlib.crc32(ids[s : s + m])
                source = pa.array(rows[doc])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(source), pa.array(start), pa.array(length), pa.array(crc), pa.array(n[rows][doc]), pa.array(w), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return (
        table.join(bases, ["pid", "key"])
        .select("group", "number", "doc_id", "n", (F.col("base") + F.col("local")).alias("first"), "wide", "ids")
        .mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )
