"""Suffix-array deduplication: removes every byte of a 100-byte string that starts earlier.

Suffixes are sampled where the least fingerprint of 32 bytes within a window
lies; fingerprints name what they agree on and bring together suffixes that can
have a window in common.  Where names leave a question, the suffixes themselves
are fetched and sorted by the deep-shallow method, and equal neighbours of a
window's length are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deepshallow import sorted_classes
from .repeats import SPAN, Unit, beside_documents, each_document, merged, repeated_spans
from .textarrays import BYTE_VALUE, U64, Spans, Texts, mix

WIDTH, GRAM = 100, 32
PLACE_BITS = 22


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` adjacent values, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def byte_anchors(texts: Texts, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows whose least gram (ties: the leftmost) is at one place."""
    data, offsets = texts.data, texts.offsets
    empty = np.zeros(0, np.int64)
    if len(data) < width:
        return empty, empty.astype(U64), empty.astype(U64), empty, empty
    spans = Spans(BYTE_VALUE[data])
    grams = width - gram + 1
    long = np.flatnonzero(np.diff(offsets) >= width)
    begins, ends = offsets[long], offsets[long + 1] - width + 1  # of window starts
    out = []
    step = (1 << PLACE_BITS) - width  # places of one stretch fit into PLACE_BITS
    for low in range(0, len(data) - width + 1, step):
        high = min(low + step, len(data) - width + 1)
        last = high - 1 + width - gram + 1
        at = np.arange(low, last)
        h = spans(at, at + gram)
        least = sliding_least((h & ~U64((1 << PLACE_BITS) - 1)) | (at - low).astype(U64), grams)
        fresh = np.zeros(high - low + 1, bool)
        fresh[1:-1] = least[1:] != least[:-1]
        fresh[0] = fresh[-1] = True
        inside = np.zeros(high - low + 1, np.int32)
        for edge, sign in ((begins, 1), (ends, -1)):
            place = np.clip(edge, low, high) - low
            np.add.at(inside, place, sign)
            fresh[place] = True
        cut = np.flatnonzero(fresh)
        start, stop = cut[:-1], cut[1:]
        valid = np.cumsum(inside)[start] > 0
        start, stop = start[valid], stop[valid]
        key = mix(h[(least[start] & U64((1 << PLACE_BITS) - 1)).astype(np.int64)])
        out.append((start + low, stop - start, key))
    start, n, key = (np.concatenate(x) for x in zip(*out))
    doc = np.searchsorted(offsets, start, "right") - 1
    return doc, key, spans(start, start + n - 1 + width), start - offsets[doc], n


def byte_bodies(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def byte_windows(width: int):
    return lambda body: (Spans(BYTE_VALUE[np.frombuffer(body, np.uint8)]).sliding(width), [body[i : i + width] for i in range(len(body) - width + 1)])


def byte_resolver(width: int):
    def resolve(runs: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
        data = b"".join(r[3] for r in runs)
        begins = np.cumsum([0, *(len(r[3]) for r in runs[:-1])])
        counts = np.array([r[2] for r in runs])
        starts = np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        out = []
        for equal in sorted_classes(data, starts, width):
            if len(equal) > 1:
                run = np.searchsorted(begins, equal, "right") - 1
                places = [(runs[r][0], runs[r][1] + s - int(begins[r])) for r, s in zip(run.tolist(), equal)]
                first = min(places)
                out += [p for p in places if p != first]
        return out

    return resolve


def byte_unit(width: int = WIDTH) -> Unit:
    gram = min(GRAM, max(1, width // 2))
    return Unit("suffix", width, lambda t: byte_anchors(t, width, gram), byte_bodies, byte_windows(width), byte_resolver(width))


def kept_text(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, extra: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``with_text`` also kept (a string,
    without what a cut has left of a split character), and columns ``extra`` of ``docs``.

    Texts are whole UTF-8 bytes; a null text is empty, and texts shorter than
    ``width`` lose nothing.  Rows with a null id neither lose bytes nor make
    others lose them.  Rows of one id are one document: of equal texts under one
    id nothing is removed on their account, and where texts under one id differ,
    what is removed at a place of one is removed at that place of the others.
    Other columns, whatever their names, are ignored unless in ``extra``.
    """
    extra = extra or []
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"x{i}") for i, c in enumerate(extra)))
    spans, buckets = repeated_spans(whole.select("doc_id", "text"), byte_unit(width))

    def handle(part: pa.RecordBatch, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = []
        for _, raw, mine in each_document(part, found):
            mine = merged(mine)
            kept, at, removed = [], 0, 0
            for a, b in zip(mine["start"].tolist(), np.minimum(mine["end"], len(raw)).tolist()):
                if b > a:
                    kept.append(raw[at:a])
                    removed += b - a
                    at = b
            left = b"".join([*kept, raw[at:]])
            rows.append((len(raw), removed, len(kept), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
        columns = list(zip(*rows)) or [[]] * 5
        made = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        if not with_text:
            made, names = made[:4], names[:4]
        yield pa.RecordBatch.from_arrays([part.column(0), *made, *part.columns[2:]], names=["doc_id", *names, *(f"x{i}" for i in range(len(extra)))])

    kinds = [f"x{i} {whole.schema[f'x{i}'].dataType.simpleString()}" for i in range(len(extra))]
    schema = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["kept string"] if with_text else []), *kinds])
    return beside_documents(whole, spans, SPAN, buckets, handle, schema)
