"""Finding what a corpus repeats: every window of fixed width that also starts earlier.

Earlier means a smaller document id, or the same document and an earlier start.
A window is ``width`` adjacent units (bytes or words) of one document.  The
search is exact and never compares all pairs of anything:

1. Each document gives anchors.  An anchor has a key, and a run of adjacent
   windows that hold it; windows of equal content lie in runs of equal key.
   Equal runs that one task sees are settled there: only the first is sent on.
2. Anchors meet by key.  Of equal runs the first stays and the others are
   repeats in full, as their windows are.  Different runs of one key may share
   some windows; one run of each content is asked for (a request).
3. Requests meet the documents, and what they ask for meets by key, where a
   resolver compares them and finds the windows that start earlier in another
   run.  A key with more runs than ``WIDE`` is asked for window by window, each
   under its own fingerprint and once a batch, so that no task gets an unbounded
   group; these meet a resolver too.
4. Spans meet the documents again and are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .buckets import how_many
from .textarrays import U64, Texts, text_groups, xxhash64_long

ANCHOR = np.dtype([("key", "<u8"), ("run", "<u4"), ("run2", "<u2"), ("doc", "<i8"), ("start", "<u4"), ("n", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
REQUEST = np.dtype([("doc", "<i8"), ("start", "<u4"), ("n", "u1"), ("wide", "u1"), ("key", "<u8")])
FLUSH = 1 << 20
WIDE = 512

#: One requested run: its windows start at units start .. start + n - 1 of doc; body holds their units.
BODIES = "key long, doc long, start long, n int, covered boolean, body binary"


@dataclass(frozen=True)
class Unit:
    """What windows are made of."""

    name: str
    width: int
    #: Anchors of a group of documents: index of the document, key, fingerprint of the run, start, number of windows.
    anchors: Callable[[Texts], tuple[np.ndarray, ...]]
    #: Bodies of units start .. end of single texts.
    bodies: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]]
    #: Fingerprints and bodies of all windows of a body.
    windows: Callable[[bytes], tuple[np.ndarray, list[bytes]]]
    #: Given the runs of one key (doc, start, n, body), the (doc, start) of windows that also start earlier.
    resolve: Callable[[list[tuple[int, int, int, bytes]]], list[tuple[int, int]]]


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans of each document, sorted, with those that meet made one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans["start"], spans["doc"]))]
    doc, start, end = spans["doc"], spans["start"].astype(np.int64), spans["end"].astype(np.int64)
    # Ends run on within a document: lift each document above all before it.
    lift = np.cumsum(np.r_[0, doc[1:] != doc[:-1]]) * (1 << 33)
    reach = np.maximum.accumulate(end + lift)
    fresh = np.r_[True, start[1:] + lift[1:] > reach[:-1]]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(spans)] - 1
    out = spans[first]
    out["end"] = reach[last] - lift[last]
    return out


def _firsts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in order, which of them begin a group of equal runs, and which stand at the place of that first one."""
    a = a[np.lexsort((a["start"], a["doc"], a["run2"], a["run"], a["key"]))]
    fresh = np.r_[True, (a["key"][1:] != a["key"][:-1]) | (a["run"][1:] != a["run"][:-1]) | (a["run2"][1:] != a["run2"][:-1])]
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    same = (a["doc"] == a["doc"][lead]) & (a["start"] == a["start"][lead])
    return a, fresh, same


def _spans_of(a: np.ndarray, width: int) -> np.ndarray:
    out = np.empty(len(a), SPAN)
    out["doc"], out["start"], out["end"] = a["doc"], a["start"], a["start"].astype(np.int64) + a["n"] - 1 + width
    return merged(out)


def _blobs(records: np.ndarray, bucket: np.ndarray, buckets: int) -> dict[int, bytes]:
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    raw, size = records[order].tobytes(), records.dtype.itemsize
    return {int(b): raw[cut[b] * size : cut[b + 1] * size] for b in np.flatnonzero(np.diff(cut))}


def _two_blobs(name: str, x: dict[int, bytes], y: dict[int, bytes], names: tuple[str, str]) -> pa.RecordBatch:
    both = sorted({*x, *y})
    return pa.RecordBatch.from_arrays([pa.array(both, pa.int32()), pa.array([x.get(b) for b in both], pa.binary()), pa.array([y.get(b) for b in both], pa.binary())], names=[name, *names])


def _dealt(docs: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """bucket, anchors, spans: anchors by key; spans of repeats that a task has seen itself go along in any bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            a, fresh, same = _firsts(np.concatenate(held))
            spans = _spans_of(a[~same], unit.width)
            first = a[fresh]
            return _two_blobs("bucket", _blobs(first, (first["key"] % U64(buckets)).astype(np.int64), buckets), _blobs(spans, xxhash64_long(spans["doc"]) % buckets, buckets), ("anchors", "spans"))

        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for group in text_groups(batch.column("text")):
                doc, key, fingerprint, start, n = unit.anchors(group)
                a = np.empty(len(doc), ANCHOR)
                a["doc"], a["key"], a["start"], a["n"] = ids[group.first + doc], key, start, n
                a["run"], a["run2"] = fingerprint >> U64(32), fingerprint & U64(0xFFFF)
                held.append(a)
                total += len(a)
                if total >= FLUSH:
                    yield flush()
                    held, total = [], 0
        if total:
            yield flush()

    return docs.mapInArrow(run, "bucket int, anchors binary, spans binary")


def _met(dealt: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """place, spans, requests: by the documents' bucket."""
    spark = dealt.sparkSession

    def settle(anchors: list, spans: list) -> tuple[np.ndarray, np.ndarray]:
        done = [np.concatenate(spans)] if spans else []
        asked = np.zeros(0, REQUEST)
        if anchors:
            a, fresh, same = _firsts(np.concatenate(anchors))
            done.append(_spans_of(a[~same], unit.width))
            first = a[fresh]
            begin = np.flatnonzero(np.r_[True, first["key"][1:] != first["key"][:-1]])
            runs = np.repeat(np.diff(np.r_[begin, len(first)]), np.diff(np.r_[begin, len(first)]))
            several = first[runs > 1]
            asked = np.empty(len(several), REQUEST)
            for name in ("doc", "start", "n", "key"):
                asked[name] = several[name]
            asked["wide"] = runs[runs > 1] > WIDE
        return np.concatenate(done) if done else np.zeros(0, SPAN), asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors, spans, settled, total = None, [], [], [], 0

        def flush() -> pa.RecordBatch:
            found, asked = merged(np.concatenate([s[0] for s in settled])), np.concatenate([s[1] for s in settled])
            return _two_blobs("place", _blobs(found, xxhash64_long(found["doc"]) % buckets, buckets), _blobs(asked, xxhash64_long(asked["doc"]) % buckets, buckets), ("spans", "requests"))

        for batch in batches:
            for b, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if b != at and at is not None:
                    settled.append(settle(anchors, spans))
                    total += len(settled[-1][0]) + len(settled[-1][1])
                    anchors, spans = [], []
                    if total >= FLUSH:
                        yield flush()
                        settled, total = [], 0
                at = b
                if x.is_valid:
                    anchors.append(np.frombuffer(x.as_buffer(), ANCHOR))
                if y.is_valid:
                    spans.append(np.frombuffer(y.as_buffer(), SPAN))
        if at is not None:
            settled.append(settle(anchors, spans))
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "place int, spans binary, requests binary")


def beside_documents(docs: DataFrame, records: list[DataFrame], kind: np.dtype, buckets: int, handle: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``handle(rows of documents, sorted records)``: documents meet the records (place, records) of their bucket, which come first and are held for one bucket at a time.

    ``docs`` has doc_id first; a null id meets no record.
    """
    spark = docs.sparkSession
    placed = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("place"), F.lit(1).alias("later"), F.lit(None).cast("binary").alias("records"), *docs.columns)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields]
    rows = reduce(DataFrame.unionByName, [r.select("place", F.lit(0).alias("later"), "records", *nothing) for r in records], placed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for batch in batches:
            place, later = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (later[1:] != later[:-1]), True]) if len(place) else []
            for a, b in zip(cut[:-1], cut[1:]):
                if place[a] != at:
                    at, held, ready = place[a], [], None
                part = batch.slice(a, b - a)
                if not later[a]:
                    held += [np.frombuffer(r.as_buffer(), kind) for r in part.column(2)]
                    continue
                if ready is None:
                    ready = np.concatenate(held) if held else np.zeros(0, kind)
                    ready = ready[np.argsort(ready["doc"], kind="stable")]
                    held = []
                yield from handle(part.select(list(range(3, batch.num_columns))), ready)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "place").sortWithinPartitions("place", "later").mapInArrow(run, schema)


def each_document(part: pa.RecordBatch, records: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Row, text bytes and the records of each document of ``part`` (doc_id and text are its first columns)."""
    ids = part.column(0)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy()
    low, high = np.searchsorted(records["doc"], values, "left"), np.searchsorted(records["doc"], values, "right")
    for group in text_groups(part.column(1)):
        raw = group.data.tobytes()
        for i in range(len(group)):
            row = group.first + i
            mine = records[low[row] : high[row]] if known[row] else records[:0]
            yield row, raw[group.offsets[i] : group.offsets[i + 1]], mine


def _bodies(docs: DataFrame, found: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    def handle(part: pa.RecordBatch, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(asked):
            return
        out: list[tuple] = []
        seen: dict[tuple[int, bytes], tuple[int, int]] = {}  # windows of wide keys that this batch has met
        ids = part.column(0)
        for row, raw, mine in each_document(part, asked):
            if not len(mine):
                continue
            doc = ids[row].as_py()
            bodies = unit.bodies(raw, mine["start"].astype(np.int64), mine["start"].astype(np.int64) + mine["n"] - 1 + unit.width)
            for r, body in zip(mine.tolist(), bodies):
                _, start, n, wide, key = r
                if not wide:
                    out.append((key - (1 << 64) if key >> 63 else key, doc, start, n, False, body))
                    continue
                hashes, contents = unit.windows(body)
                for k, window in enumerate(zip(hashes.view(np.int64).tolist(), contents)):
                    here = (doc, start + k)
                    first = seen.setdefault(window, here)
                    if first == here:
                        continue
                    later = max(first, here)
                    seen[window] = min(first, here)
                    out.append((window[0], *later, 1, True, None))
        out += [(h, *here, 1, False, content) for (h, content), here in seen.items()]
        columns = list(zip(*out)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "doc", "start", "n", "covered", "body"])

    asked = found.where("requests is not null").select("place", F.col("requests").alias("records"))
    return beside_documents(docs, [asked], REQUEST, buckets, handle, BODIES)


def _resolved(bodies: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """place, records: spans of requested runs that also start earlier."""
    spark = bodies.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            spans = np.empty(len(found), SPAN)
            both = np.array(found, np.int64).reshape(-1, 2)
            spans["doc"], spans["start"], spans["end"] = both[:, 0], both[:, 1], both[:, 1] + unit.width
            spans = merged(spans)
            blobs = _blobs(spans, xxhash64_long(spans["doc"]) % buckets, buckets)
            return pa.RecordBatch.from_arrays([pa.array(list(blobs), pa.int32()), pa.array(list(blobs.values()), pa.binary())], names=["place", "records"])

        at, runs = None, []
        for batch in batches:
            for key, doc, start, n, covered, body in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if key != at:
                    found += settled(runs)
                    at, runs = key, []
                if covered:
                    found.append((doc, start))
                else:
                    runs.append((doc, start, n, body))
            if len(found) > 500_000:
                yield flush()
                found = []
        found += settled(runs)
        if found:
            yield flush()

    def settled(runs: list) -> list[tuple[int, int]]:
        return unit.resolve(runs) if len(runs) > 1 else []

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return bodies.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "place int, records binary")


def repeated_spans(docs: DataFrame, unit: Unit) -> tuple[list[DataFrame], int]:
    """Tables (place, records of SPAN) of what starts earlier elsewhere in ``docs`` (doc_id, text), and their number of buckets."""
    spark = docs.sparkSession
    buckets = how_many(spark)
    known = docs.where("doc_id is not null")
    found = scratch.written(_met(_dealt(known, unit, buckets), unit, buckets), f"{unit.name}-met")
    scratch.free_shuffles(spark)
    more = scratch.written(_resolved(_bodies(known, found, unit, buckets), unit, buckets), f"{unit.name}-resolved")
    scratch.free_shuffles(spark)
    return [found.where("spans is not null").select("place", F.col("spans").alias("records")), more], buckets


def fingerprint_groups(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows have an equal one at an earlier place."""
    order = np.lexsort((start, doc, hashes))
    h, d, s = hashes[order], doc[order], start[order]
    fresh = np.r_[True, h[1:] != h[:-1]]
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    out = np.zeros(len(h), bool)
    out[order] = (d != d[lead]) | (s != s[lead])
    return out
