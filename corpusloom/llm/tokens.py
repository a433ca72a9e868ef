"""Token ids of whole texts by a public tokenizer file.

A tokenizer of lower-cased words never merges across white space, nor between an
ASCII letter and an ASCII character that is neither letter nor apostrophe, so a
text's ids are those of its pieces in order.  Distinct pieces are encoded once a
worker and kept in a bounded table; texts are then put together by array
operations.  Any other tokenizer, as told by its file, gets whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import BYTE_VALUE, SPACE, Spans, Texts, text_groups

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Bytes of a group of texts: each group with new pieces merges the whole table of pieces.
ENCODED_BYTES = 1 << 20
#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 3_000_000

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True

# How a tokenizer file says that it lower-cases and splits as the pieces here need it.
LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT_AT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def takes_pieces(file: dict) -> bool:
    """Whether a tokenizer file is of lower-cased words, split by SPLIT_AT into parts that are encoded alone."""
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": SPLIT_AT}, "behavior": "Removed", "invert": True}
    lowered = (file.get("normalizer") or {}).get("normalizers") == LOWERED
    return lowered and steps[0] == split and all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in steps[1:])


class Encoder:
    """Ids of texts under a tokenizer file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_pieces = takes_pieces(json.load(f))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _look_up(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the keys in the table; unknown pieces are encoded first."""
        at = np.searchsorted(self.keys, keys)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] == keys[found]
        if not found.all():
            if len(self.keys) > REMEMBERED:
                self.forget()
                found[:] = False
            new = np.flatnonzero(~found)
            raw = data.tobytes()
            made = self._raw([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            count = np.fromiter(map(len, made), np.int64, len(made))
            begin = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, np.fromiter((i for m in made for i in m), self.kind, int(count.sum()))])
            every = np.concatenate([self.keys, keys[new]])
            order = np.argsort(every, kind="stable")
            self.keys = every[order]
            self.begin = np.concatenate([self.begin, begin])[order]
            self.count = np.concatenate([self.count, count])[order]
            at = np.searchsorted(self.keys, keys)
        return at

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, each followed by END_ID, and the offsets of documents."""
        if not self.by_pieces:
            every = texts.data.tobytes()
            made = self._raw([every[a:b].decode("utf-8", "replace") for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist())])
            offsets = np.concatenate([[0], np.cumsum([len(m) + 1 for m in made])]).astype(np.int64)
            return np.fromiter((i for m in made for i in (*m, END_ID)), self.kind, int(offsets[-1])), offsets
        raw = texts.data.tobytes() if any(len(texts.data) >= len(s) for s in self.special) else b""
        whole = set()
        for mark in self.special:
            i = raw.find(mark)
            while i >= 0:
                whole.add(int(np.searchsorted(texts.offsets, i, "right")) - 1)
                i = raw.find(mark, i + 1)
        ids, offsets = self._encode_pieces(texts)
        if not whole:
            return ids, offsets
        parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        for d in whole:  # a special token's own string: only the tokenizer knows where it may match
            parts[d] = np.array(self._raw([raw[texts.offsets[d] : texts.offsets[d + 1]].decode("utf-8", "replace")])[0] + [END_ID], self.kind)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _encode_pieces(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        data, n, docs = texts.data.copy(), len(texts.data), len(texts)
        if not n:
            return np.full(docs, END_ID, self.kind), np.arange(docs + 1)
        # A capital before a byte beyond ASCII may compose with a mark, so it stays.
        fold = UPPER[data]
        fold[:-1] &= data[1:] < 128
        data[fold] += 32
        space, letter = SPACE[data], LETTER[data]
        plain = (data < 128) & (data != ord("'"))
        cut = np.zeros(n + 1, bool)  # a piece may begin here
        cut[1:n] = space[1:] | space[:-1] | (plain[1:] & plain[:-1] & (letter[1:] != letter[:-1]))
        cut[texts.offsets] = True
        cut[0] = cut[n] = True
        bounds = np.flatnonzero(cut)
        starts, ends = bounds[:-1], bounds[1:]
        real = ~space[starts]
        starts, ends = starts[real], ends[real]
        keys, first, inverse = np.unique(Spans(BYTE_VALUE[data])(starts, ends), return_index=True, return_inverse=True)
        at = self._look_up(keys, data, starts[first], ends[first])[inverse]
        count = self.count[at]
        per_piece = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(per_piece[-1] + docs, self.kind)
        doc_pieces = np.searchsorted(starts, texts.offsets)
        doc_ends = per_piece[doc_pieces[1:]]
        source = np.arange(per_piece[-1]) - np.repeat(per_piece[:-1] - self.begin[at], count)
        owner = np.searchsorted(doc_ends, np.arange(per_piece[-1]), "right")
        out[np.arange(per_piece[-1]) + owner] = self.ids[source]
        out[doc_ends + np.arange(docs)] = END_ID
        return out, np.concatenate([[0], doc_ends + np.arange(1, docs + 1)])


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Encoder(path)


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str | None, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Groups of rows with the ids of their texts and offsets."""
    enc = encoder(path)
    for batch in batches:
        for group in text_groups(batch.column(text), ENCODED_BYTES):
            yield batch.slice(group.first, len(group)), *enc.encode(group)


def source_key(source: Column) -> Column:
    """A string for each source, another for each; null has one too."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def token_table(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """pid, key (of the source), doc_id, n, local (tokens of the source before it in its partition), wide, ids (little-endian)."""
    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), source_key(F.col(source_col)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, before = TaskContext.get().partitionId(), {}
        for rows, ids, offsets in encoded_batches(batches, path):
            n = np.diff(offsets)
            coded = rows.column("key").dictionary_encode()
            queue, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            order = np.argsort(queue, kind="stable")
            sums = np.cumsum(n[order]) - n[order]
            begin = np.searchsorted(queue[order], queue[order])
            local = np.empty(len(n), np.int64)
            local[order] = sums - sums[begin] + np.array([before.get(k, 0) for k in names], np.int64)[queue[order]]
            for k, more in zip(names, np.bincount(queue, n, len(names)).tolist()):
                before[k] = before.get(k, 0) + int(more)
            blobs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((offsets * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), pid, np.int32)), rows.column("key"), rows.column("doc_id"), pa.array(n), pa.array(local), pa.array(np.full(len(n), ids.itemsize == 4)), blobs], names=["pid", "key", "doc_id", "n", "local", "wide", "ids"])

    return inner.mapInArrow(run, "pid int, key string, doc_id long, n long, local long, wide boolean, ids binary")
