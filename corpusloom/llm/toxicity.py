"""Toxicity scores by FTRL-proximal logistic regression over hashed word features.

Features of a document: the presence of each word, word pair (2-gram) and
skip-gram (two words with one or two between them), lower-cased, without
surrounding punctuation, hashed into ``2 ** bits`` weights.  The optimiser has a
learning rate per coordinate and an L1 term, so few weights are left; these are
all that executors get.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textarrays import BYTE_VALUE, U64, Spans, Texts, constants, mix, text_groups

#: Bytes that are part of a word: letters, digits, apostrophe and all beyond ASCII.
PART = np.zeros(256, bool)
PART[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), ord("'"), *range(128, 256)]] = True
PAIR, SKIP1, SKIP2 = constants(3, 77)


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    #: At most so many labelled rows of class 0 and of class 1 are learned from, the first by a hash of their id.
    #: Classes keep a ratio near that of ordinary text, so that clean documents are left alone.
    sample: tuple[int, int] = (16_000, 4_000)
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.5


def features(texts: Texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each feature, repeats included, and the document it belongs to; words first, then pairs and skip-grams."""
    texts = texts.lower()
    part = PART[texts.data]
    n = len(part)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.zeros(n + 1, bool)
    begin[texts.offsets[:-1]] = True
    fresh = begin[:n]
    first = part.copy()
    first[1:] &= ~part[:-1] | fresh[1:]
    last = part.copy()
    last[:-1] &= ~part[1:] | fresh[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = Spans(BYTE_VALUE[texts.data])(starts, ends)
    owner = np.searchsorted(texts.offsets, starts, "right") - 1
    slots, owners = [words], [owner]
    for step, salt in ((1, PAIR), (2, SKIP1), (3, SKIP2)):
        same = owner[step:] == owner[:-step]
        slots.append(mix(words[:-step] * salt + words[step:])[same] if len(words) > step else words[:0])
        owners.append(owner[step:][same] if len(words) > step else owner[:0])
    return (np.concatenate(slots) >> U64(64 - bits)).astype(np.int64), np.concatenate(owners)


@dataclass
class Ftrl:
    """FTRL-proximal with per-coordinate rates over binary features."""

    settings: Settings
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z = np.zeros((1 << self.settings.bits) + 1)  # the last is the bias
        self.n = np.zeros_like(self.z)

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z = self.settings, self.z[at]
        pull = np.where(at == len(self.z) - 1, 0.0, s.l1)
        return np.where(np.abs(z) <= pull, 0.0, -(z - np.sign(z) * pull) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2))

    def learn(self, slots: np.ndarray, label: int, weight: float = 1.0) -> float:
        at = np.append(slots, len(self.z) - 1)
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - label) * weight
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.settings.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        return p

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Slots with weight, their weights, and the bias."""
        every = self.weights(np.arange(len(self.z)))
        kept = np.flatnonzero(every[:-1])
        return kept, every[kept].astype(np.float32), float(every[-1])


def lift(ones: int, every: int) -> float:
    """Weight of a toxic example: classes weigh alike in sum up to a factor of two."""
    return min(2.0, max(1.0, (every - ones) / max(ones, 1)))


def fit(examples: list[tuple[np.ndarray, int]], settings: Settings) -> Ftrl:
    """Learn from (distinct slots, label) pairs that are in memory, in a fixed shuffled order."""
    model = Ftrl(settings)
    weight = lift(sum(y for _, y in examples), len(examples))
    rng = np.random.default_rng(5)
    for _ in range(settings.epochs):
        for i in rng.permutation(len(examples)):
            slots, y = examples[i]
            model.learn(slots, y, weight if y else 1.0)
    return model


def train(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learned from a bounded sample of labelled rows outside the held-out fold.

    The sample is the first ``settings.sample`` ids of each class by a hash of
    the id; only their ids and labels reach the driver.  The slots of their whole
    texts are written once.  In each epoch one task reads them in an order of its
    own, sorted by Spark, which spills if need be, and learns batch by batch; it
    returns the state of the optimiser (16 bytes a slot), from which the next
    epoch goes on.  Its memory is that state and a batch, however long texts are.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y")).where(~held_out(F.col("id")))
    picked = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(settings.sample[y]).collect()]
    if not picked:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0
    sample = F.broadcast(spark.createDataFrame([(r.id, r.y) for r in picked], "id long, y int"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(sample, "id")

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in text_groups(batch.column("text")):
                slots, owner = features(group, settings.bits)
                order = np.argsort(owner, kind="stable")
                bounds = np.searchsorted(owner[order], np.arange(len(group) + 1))
                found = [np.unique(slots[order[a:b]]).astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(group.first, len(group)) for c in ("id", "y")), pa.array(found, pa.binary())], names=["id", "y", "slots"])

    examples = scratch.written(texts.mapInArrow(slots_of, "id long, y int, slots binary"), "toxicity-examples")
    every, ones = examples.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).head()
    weight, state = lift(ones, every), None
    for epoch in range(settings.epochs if every else 0):

        def learn(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            model = Ftrl(settings)
            if state is not None:
                model.z, model.n = (np.frombuffer(raw, "<f8").copy() for raw in state)
            for batch in batches:
                for slots, y in zip(batch.column("slots"), batch.column("y").to_pylist()):
                    model.learn(np.frombuffer(slots.as_buffer(), "<i4").astype(np.int64), y, weight if y else 1.0)
            yield pa.RecordBatch.from_arrays([pa.array([a.astype("<f8").tobytes()]) for a in (model.z, model.n)], names=["z", "n"])

        ordered = examples.coalesce(1).sortWithinPartitions(F.xxhash64("id", F.lit(epoch)), "id", "slots")
        state = tuple(map(bytes, ordered.mapInArrow(learn, "z binary, n binary").head()))
    model = Ftrl(settings)
    if state is not None:
        model.z, model.n = (np.frombuffer(raw, "<f8") for raw in state)
    return model.compact()


def held_out(id_column):
    """Fold 0 of 5 by the CRC-32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def scored(batches: Iterator, weights: np.ndarray, used: np.ndarray, bias: float, bits: int, name: str) -> Iterator[pa.RecordBatch]:
    """Batches with a ``score`` appended."""
    for batch in batches:
        scores = []
        for group in text_groups(batch.column(name)):
            slots, owner = features(group, bits)
            hit = used[slots]
            both = np.unique(owner[hit] << bits | slots[hit])  # presence: each slot once a document
            total = np.bincount(both >> bits, weights[both & ((1 << bits) - 1)], len(group)) + bias
            scores.append(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))
        out = pa.array(np.concatenate(scores) if scores else np.zeros(0))
        yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "score"])


def with_score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """``docs`` (columns ``keep``, all by default) with a double ``score_col``, one row per input row.

    Null and empty texts get the score of the bias; without usable labels every
    score is 0.5.  Null ids are scored like others and are never learned from;
    an id labelled more than once counts as toxic if any of its labels does.
    """
    kept, w, bias = train(docs, labels, settings, id_col, text_col, label_col)
    weights = np.zeros(1 << settings.bits, np.float32)
    weights[kept] = w
    used = weights != 0
    names = keep or docs.columns
    inner = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.col(text_col).alias("scored_text"))
    schema = ", ".join(f"c{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(names)))
    bits = settings.bits
    shared = docs.sparkSession.sparkContext.broadcast((weights[used], np.packbits(used), bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compact, packed, b = shared.value
        mask = np.unpackbits(packed)[: 1 << bits].astype(bool)
        full = np.zeros(1 << bits, np.float32)
        full[mask] = compact
        for batch in scored(batches, full, mask, b, bits, "scored_text"):
            yield batch.select([c for c in batch.schema.names if c != "scored_text"])

    out = inner.mapInArrow(score, f"{schema}, score double")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("score").alias(score_col))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5) of every document."""
    s = with_score(docs, labels, settings, id_col, text_col, keep=[id_col])
    return s.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
