"""Substring deduplication by difference-cover anchors: removes words of 20-word windows that start earlier.

Positions of a document are numbered by word.  ``COVER`` holds every difference
modulo ``PERIOD``, so for any two places some shift below the period brings both
to covered positions.  Two equal windows therefore have an equal anchor, the
words from a covered position on, within both; only those are hashed and
exchanged, and each is extended to the windows that hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import SPAN, Unit, beside_documents, each_document, fingerprint_groups, merged, repeated_spans
from .textarrays import U64, Spans, Texts, mix, text_groups

WIDTH = 20
#: A perfect difference set: every residue is a difference of two of its numbers.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR_WORDS = WIDTH - PERIOD + 1
COVERED = np.isin(np.arange(PERIOD), COVER)


def word_anchors(texts: Texts) -> tuple[np.ndarray, ...]:
    words = texts.words()
    offsets = words.offsets
    spans = Spans(words.fingerprints())
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(offsets[-1]) - offsets[:-1][doc]
    chosen = np.flatnonzero(COVERED[at % PERIOD])
    doc, at = doc[chosen], at[chosen]
    # Windows that hold the anchor and lie in the document.
    first, last = np.maximum(0, at - PERIOD + 1), np.minimum(at, counts[doc] - WIDTH)
    good = last >= first
    doc, at, first, last = doc[good], at[good], first[good], last[good]
    base = offsets[:-1][doc]
    return doc, mix(spans(base + at, base + at + ANCHOR_WORDS) ^ U64(5)), spans(base + first, base + last + WIDTH), first, last - first + 1


def word_bodies(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    words = raw.split()
    return [b" ".join(words[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]


def word_windows(body: bytes) -> tuple[np.ndarray, list[bytes]]:
    (group,) = text_groups(pa.array([body], pa.binary()))
    words = body.split(b" ")
    return Spans(group.words().fingerprints()).sliding(WIDTH), [b" ".join(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)]


def word_resolver(runs: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """Extends the anchors of one key to their windows, which meet across runs by fingerprint and are then compared word by word."""
    hashes, doc, start = [], [], []
    bodies = pa.array([r[3] for r in runs], pa.binary())
    row = 0
    for group in text_groups(bodies):
        words = group.words()
        every = Spans(words.fingerprints()).sliding(WIDTH)
        for i in range(len(group)):
            d, s, n, _ = runs[row]
            a = words.offsets[i]
            hashes.append(every[a : a + n])
            doc.append(np.full(n, d))
            start.append(np.arange(s, s + n))
            row += 1
    hashes, doc, start = np.concatenate(hashes), np.concatenate(doc), np.concatenate(start)
    again = fingerprint_groups(hashes, doc, start)
    alike = np.flatnonzero(np.isin(hashes, hashes[again]))
    counts = np.array([r[2] for r in runs])
    of = np.repeat(np.arange(len(runs)), counts)[alike]
    split = {r: runs[r][3].split(b" ") for r in np.unique(of).tolist()}
    first: dict[tuple[bytes, ...], tuple[int, int]] = {}
    places = []
    for r, d, s in zip(of.tolist(), doc[alike].tolist(), start[alike].tolist()):
        k = s - runs[r][1]
        content = tuple(split[r][k : k + WIDTH])
        places.append((content, (d, s)))
        first[content] = min(first.get(content, (d, s)), (d, s))
    return [place for content, place in places if place != first[content]]


UNIT = Unit("anchor", WIDTH, word_anchors, word_bodies, word_windows, word_resolver)


def kept_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with ``with_text`` also kept (the words left, joined by a space).

    Words are runs of bytes other than space and U+0009 to U+000D, unchanged; a
    null text has none, and texts of fewer than 20 words lose nothing.  Rows
    with a null id neither lose words nor make others lose them.  Rows of one id
    are one document: equal texts under one id do not repeat each other, and
    where texts under one id differ, what is removed at a place of one is
    removed at that place of the others.  Other columns are ignored.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans, buckets = repeated_spans(whole, UNIT)

    def handle(part: pa.RecordBatch, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = []
        for _, raw, mine in each_document(part, found):
            words, kept, at = raw.split(), [], 0
            mine = merged(mine)
            for a, b in zip(mine["start"].tolist(), mine["end"].tolist()):
                kept += words[at:a]
                at = max(at, min(b, len(words)))
            kept += words[at:]
            left = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if with_text else None))
        columns = list(zip(*rows)) or [[]] * 4
        made = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([part.column(0), *made[: 3 + with_text]], names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])

    return beside_documents(whole, spans, SPAN, buckets, handle, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
