"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

Three rounds of random signs and a fast Hadamard transform turn a unit vector
pseudo-randomly; a polytope's hash is the signed axis it then lies nearest to.
A table concatenates as many polytopes (the last one over fewer axes) as keep
its buckets at about ``BUCKET`` vectors, however many there are.  A query probes
the buckets whose axes it lies nearest to, about the square root of the number
of vectors in each table, so it meets a share of all vectors that falls as they
grow; these are ranked exactly, in double precision.  Equal vectors are hashed
and compared once, whatever their number.

Vectors are dealt into blocks, once each, and every query goes to all blocks; a
task hashes its block into all tables.  A query's probes are not exchanged: they
are the buckets of a cost up to its reach, one number for each table, and a task
walks its own buckets, each against all queries that reach it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .textarrays import constants

TABLES, NEAREST = 16, 20
#: Vectors of a bucket, about, and probes of a table for each square root of the vectors.
BUCKET, PROBE_RATE = 256, 0.04
#: Vectors of a block, at most about and where cores wait for more blocks at least, and queries that a block answers at once.
CANDIDATE_BLOCK, LEAST_BLOCK, QUERY_BLOCK = 350_000, 5_000, 65_536
#: Blocks that are answered in one pass, or as many as there are cores: what a pass exchanges is deleted after it.
PASS = 12
#: Pairs that are sifted at once, hits that are held before the best are chosen, and vectors that are turned or ranked at once.
PAIRS, HELD, TURNED = 1 << 18, 1 << 21, 1 << 14
HIT = np.dtype([("vector", "<i8"), ("score", "<f8"), ("first", "<i8")])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, width)
        h *= 2
    return x


def polytopes(vectors: int, dim: int, bucket: int = BUCKET) -> list[int]:
    """Axes of each polytope of a table: all but for the last, whose axes make buckets of about ``bucket`` vectors."""
    width = 1 << max(1, (dim - 1).bit_length())
    axes, left = [], vectors / bucket
    while left > 2 * width:
        axes.append(width)
        left /= 2 * width
    return [*axes, min(width, 1 << max(0, math.ceil(math.log2(max(left, 2) / 2))))]


def probes_of(vectors: int, rate: float = PROBE_RATE) -> int:
    return max(3, math.ceil(rate * math.sqrt(vectors)))


def _turn(x: np.ndarray, polytope: int) -> np.ndarray:
    width = x.shape[1]
    for turn in range(3):
        signs = 1.0 - 2.0 * (constants(width, 1000 * polytope + turn + 1) >> np.uint64(63)).astype(float)
        x = hadamard(x * signs) / np.sqrt(width)
    return x


@functools.lru_cache(maxsize=256)
def _rotation(width: int, polytope: int) -> np.ndarray:
    """What the transforms do to each unit vector: of short vectors, one product with it is faster than they are."""
    return _turn(np.eye(width), polytope)


def turned(vectors: np.ndarray, polytope: int, axes: int) -> np.ndarray:
    """[len(vectors), 2 * axes] coordinates along the signed axes of a pseudo-rotation."""
    dim = vectors.shape[1]
    width = 1 << max(1, (dim - 1).bit_length())
    if width <= 128:
        x = vectors @ _rotation(width, polytope)[:dim, :axes]
    else:
        x = np.zeros((len(vectors), width))
        x[:, :dim] = vectors
        x = _turn(x, polytope)[:, :axes]
    return np.concatenate([x, -x], axis=1)


def codes(vectors: np.ndarray, table: int, axes: list[int]) -> np.ndarray:
    """[len(vectors)] the bucket of each: the nearest signed axes of its polytopes, as one number."""
    code = np.zeros(len(vectors), np.int64)
    for k, a in enumerate(axes):
        code = code * (2 * a) + turned(vectors, 100 * table + k, a).argmax(1)
    return code


def axis_costs(vectors: np.ndarray, table: int, axes: list[int]) -> list[np.ndarray]:
    """For each polytope, [len(vectors), signed axes]: how much farther an axis lies than the nearest, squared."""
    turns = (turned(vectors, 100 * table + k, a) for k, a in enumerate(axes))
    return [(x.max(1, keepdims=True) - x) ** 2 for x in turns]


def least_costs(vectors: np.ndarray, table: int, axes: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """[len(vectors), up to most] the buckets of least summed costs of their axes, and these sums."""
    code, cost = np.zeros((len(vectors), 1), np.int64), np.zeros((len(vectors), 1))
    for a, more in zip(axes, axis_costs(vectors, table, axes)):
        code = (code[:, :, None] * (2 * a) + np.arange(2 * a)).reshape(len(vectors), -1)
        cost = (cost[:, :, None] + more[:, None, :]).reshape(len(vectors), -1)
        if cost.shape[1] > most:
            least = np.argpartition(cost, most - 1, axis=1)[:, :most]
            code, cost = np.take_along_axis(code, least, 1), np.take_along_axis(cost, least, 1)
    return code, cost


def probed(vectors: np.ndarray, table: int, axes: list[int], most: int) -> np.ndarray:
    """[len(vectors), up to most] the buckets that lie nearest."""
    return least_costs(vectors, table, axes, most)[0]


def reach(vectors: np.ndarray, table: int, axes: list[int], most: int) -> np.ndarray:
    """[len(vectors)] the cost of the farthest bucket that is probed, and a little for other roundings."""
    return least_costs(vectors, table, axes, most)[1].max(1) * (1 + 1e-5) + 1e-9


def distinct_vectors(rows: DataFrame, nearest: int, query_every: int) -> DataFrame:
    """vector (fingerprint), proof (another), embedding, ids (the nearest + 1 smallest), queried, dim of each distinct vector.

    More ids than these can never be among the nearest of a query, itself left
    out.  A task cuts a vector's ids to these before they are exchanged.
    """
    keep = nearest + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector, proof, ids = (batch.column(c).to_numpy() for c in ("vector", "proof", "vec_id"))
            order = np.lexsort((ids, proof, vector))
            v, w = vector[order], proof[order]
            begin = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])]) if len(v) else np.zeros(0, np.int64)
            rank = np.arange(len(v)) - np.repeat(begin, np.diff(np.r_[begin, len(v)]))
            asked = np.add.reduceat((ids[order] % query_every == 0).astype(np.int64), begin) > 0 if len(v) else np.zeros(0, bool)
            asked = np.repeat(asked, np.diff(np.r_[begin, len(v)]))
            kept = rank < keep
            out = batch.take(pa.array(order[kept]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(asked[kept])], names=[*out.schema.names, "queried"])

    few = rows.mapInArrow(cut, f"vector long, proof long, vec_id long, embedding {_kind(rows)}, queried boolean")
    own = Window.partitionBy("vector", "proof")
    ranked = few.select("*", F.row_number().over(own.orderBy("vec_id")).alias("r"), F.max("queried").over(own).alias("asked")).where(F.col("r") <= keep)
    return ranked.groupBy("vector", "proof").agg(F.first("embedding").alias("embedding"), F.array_sort(F.collect_set("vec_id")).alias("ids"), F.max("asked").alias("queried")).withColumn("dim", F.size("embedding"))


def _as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    most = np.abs(x).max(1, keepdims=True)
    x = x / most
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kind(df: DataFrame) -> str:
    """Vectors travel as they are stored, and are doubles where they are hashed and ranked."""
    return df.schema["embedding"].dataType.simpleString()


def with_reach(queries: DataFrame, tables: int, axes_of: dict[int, list[int]], probes_of: dict[int, int]) -> DataFrame:
    """``queries`` (vector, dim, first, embedding) with the reach of each in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                whole, axes, most = batch.filter(pa.array(dims == dim)), axes_of[dim], probes_of[dim]
                step = max(1, (1 << 22) // (most * 2 * max(axes)))
                for low in range(0, whole.num_rows, step):
                    part = whole.slice(low, step)
                    x = _unit(_as_matrix(part.column("embedding"), dim))
                    far = np.stack([reach(x, t, axes, most) for t in range(tables)], axis=1).astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(far.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "reach"])

    return queries.mapInArrow(run, f"vector long, dim int, first long, embedding {_kind(queries)}, reach array<float>")


def best(hits: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` best distinct vectors: largest score, then smallest first id."""
    hits = hits[np.unique(hits["vector"], return_index=True)[1]]
    return hits[np.lexsort((hits["first"], -hits["score"]))[:keep]]


class Block:
    """Some of the vectors, hashed into all tables (none: every query meets them all)."""

    def __init__(self, vectors: np.ndarray, first: np.ndarray, x: np.ndarray, axes: list[int], tables: int, keep: int):
        self.vectors, self.first, self.x, self.axes, self.keep = vectors, first, x, axes, keep
        norms = np.concatenate([np.linalg.norm(x[a : a + TURNED].astype(np.float64), axis=1) for a in range(0, len(x), TURNED)])
        self.norm, self.plain = norms.max(), x.dtype == np.float32 and 1e-10 < norms.min() and norms.max() < 1e10
        code = np.empty((tables, len(x)), np.int32 if math.prod(2 * a for a in axes) < 1 << 31 else np.int64)
        for low in range(0, len(x), TURNED):
            unit = _unit(x[low : low + TURNED])
            for t in range(tables):
                code[t, low : low + TURNED] = codes(unit, t, axes)
        self.order = np.empty((tables, len(x)), np.int32)
        for t in range(tables):
            self.order[t] = np.argsort(code[t], kind="stable")
            code[t] = code[t, self.order[t]]
        self.code = code

    def buckets(self, table: int, costs: list[np.ndarray], query: np.ndarray, left: np.ndarray, lead: int = 0, k: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The queries that reach a bucket, and its vectors, for each bucket below ``lead`` that has both; ``left`` is what remains of their reach."""
        n = 2 * self.axes[k]
        below = math.prod(2 * a for a in self.axes[k + 1 :])
        cut = np.searchsorted(self.code[table], (lead * n + np.arange(n + 1)) * below)
        more = costs[k][:, query]
        for a in np.flatnonzero(np.diff(cut)).tolist():
            near = np.flatnonzero(more[a] <= left)
            if len(near) and below > 1:
                yield from self.buckets(table, costs, query[near], left[near] - more[a][near], lead * n + a, k + 1)
            elif len(near):
                yield query[near], self.order[table, cut[a] : cut[a + 1]]

    def met(self, q: np.ndarray, far: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        everyone = np.arange(len(q))
        if not len(self.code):
            yield everyone, np.arange(len(self.x), dtype=np.int32)
        for t in range(len(self.code)):
            costs: list[list[np.ndarray]] = []
            for low in range(0, len(q), TURNED):
                costs.append([c.T.astype(np.float32) for c in axis_costs(_unit(q[low : low + TURNED]), t, self.axes)])
            yield from self.buckets(t, [np.concatenate(c, axis=1) for c in zip(*costs)], everyone, far[:, t])

    def answer(self, vectors: np.ndarray, q: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
        """vector, hits: the ``keep`` best of each query's buckets.

        Pairs are sifted by products of whole buckets, with a margin for their
        roundings; what may be among the best is scored in double precision.
        At most 65,536 queries; the block's vectors lie in the order of first.
        """
        norms = np.linalg.norm(q.astype(np.float64), axis=1)
        kind = np.float32 if self.plain and q.dtype == np.float32 and 1e-10 < norms.min() and norms.max() < 1e10 else np.float64
        margin = 2 * (q.shape[1] + 2) * float(np.finfo(kind).eps) * norms * self.norm
        sifted, least = q.astype(kind), np.full(len(q), -np.inf, kind)
        of, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        new: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def choose() -> None:
            nonlocal of, row, score, held
            key = np.concatenate([of << 32 | row, *(a.astype(np.int64) << 32 | b for a, b in new)])
            key, at = np.unique(key, return_index=True)  # of equal pairs the first, which is scored if any is
            known = at < len(of)
            of_all, row_all, s = key >> 32, key & 0xFFFFFFFF, np.empty(len(key))
            s[known] = score[at[known]]
            fresh = np.flatnonzero(~known)
            for a in range(0, len(fresh), TURNED):
                f = fresh[a : a + TURNED]
                s[f] = np.einsum("ij,ij->i", q[of_all[f]].astype(np.float64), self.x[row_all[f]].astype(np.float64))
            order = np.argsort(-s, kind="stable")
            order = order[np.argsort(of_all[order].astype(np.uint16), kind="stable")]  # 16 bits: a radix sort
            of, row, score = of_all[order], row_all[order], s[order]
            begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
            rank = np.arange(len(of)) - np.repeat(begin, np.diff(np.r_[begin, len(of)]))
            last = rank == self.keep - 1
            with np.errstate(all="ignore"):
                bound = score[last] - margin[of[last]]
            least[of[last]] = np.where(np.isfinite(bound), bound, -np.inf)
            of, row, score = of[rank < self.keep], row[rank < self.keep], score[rank < self.keep]
            new.clear()
            held = 0

        for query, rows in self.met(q, far):
            wide = min(len(rows), 4096)
            tall = max(1, PAIRS // wide)
            for a in range(0, len(rows), wide):
                x = self.x[rows[a : a + wide]].astype(kind, copy=False).T
                for b in range(0, len(query), tall):
                    some = query[b : b + tall]
                    with np.errstate(all="ignore"):
                        i, j = np.nonzero(~(sifted[some] @ x < least[some][:, None]))
                    if len(i):
                        new.append((some[i], rows[a + j]))
                        held += len(i)
                    if held > HELD:
                        choose()
        choose()
        hits = np.empty(len(of), HIT)
        hits["vector"], hits["score"], hits["first"] = self.vectors[row], score, self.first[row]
        cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        raw, ends = hits.tobytes(), np.r_[cut[1:], len(of)] if len(cut) else cut
        return pa.RecordBatch.from_arrays([pa.array(vectors[of[cut]]), pa.array([raw[a * HIT.itemsize : b * HIT.itemsize] for a, b in zip(cut.tolist(), ends.tolist())], pa.binary())], names=["vector", "hits"])


class Rows:
    """Rows of a group as they arrive, in arrays that grow."""

    def __init__(self):
        self.n, self.held = 0, None

    def add(self, *columns: np.ndarray) -> None:
        n = len(columns[0])
        if self.held is None or self.n + n > len(self.held[0]):
            room = max(4096, (self.n + n) * 5 // 4)
            old, self.held = self.held, [np.empty((room, *c.shape[1:]), c.dtype) for c in columns]
            for new, before in zip(self.held, old or []):
                new[: self.n] = before[: self.n]
        for mine, c in zip(self.held, columns):
            mine[self.n : self.n + n] = c
        self.n += n

    def all(self) -> list[np.ndarray]:
        return [c[: self.n] for c in self.held]


def slots(spark: SparkSession, blocks: int) -> list[int]:
    """A number for each block; Spark's hash deals them into as many partitions, one each where it can."""
    place = F.pmod(F.hash("id"), F.lit(blocks))
    found = [r.id for r in spark.range(16 * blocks + 64).groupBy(place).agg(F.min("id").alias("id")).collect()]  # one row for each block
    return found + [-1 - k for k in range(blocks - len(found))]


def ranked_blocks(candidates: DataFrame, queries: DataFrame, blocks: int, these: range, axes_of: dict[int, list[int]], tables: int, keep: int) -> DataFrame:
    """vector, hits: for each query (with its reach) the ``keep`` best distinct vectors of each of ``these`` of all blocks."""
    numbers = F.split(F.lit(",".join(map(str, slots(candidates.sparkSession, len(these))))), ",").cast("array<long>")
    block = F.pmod(F.xxhash64("vector", F.lit("block")), F.lit(blocks)).cast("int")
    one = candidates.where(block.between(these.start, these.stop - 1)).select(F.get(numbers, block - these.start).alias("slot"), "dim", F.lit(False).alias("query"), "vector", "first", "embedding", F.lit(None).cast("array<float>").alias("reach"))
    dealt = one.unionByName(queries.select(F.explode(numbers).alias("slot"), "dim", F.lit(True).alias("query"), "vector", "first", "embedding", "reach"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine, asked, block = None, Rows(), Rows(), None

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal block, mine, asked
            if mine.n and asked.n:
                block = block or Block(*mine.all(), axes_of[group[1]], tables, keep)
                vectors, q, far = asked.all()
                for low in range(0, asked.n, QUERY_BLOCK):
                    yield block.answer(vectors[low : low + QUERY_BLOCK], q[low : low + QUERY_BLOCK], far[low : low + QUERY_BLOCK])
            asked = Rows()

        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "dim", "query")]
            cut = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]), True]) if batch.num_rows else []
            for a, b in zip(cut[:-1], cut[1:]):
                here = tuple(int(k[a]) for k in keys[:2])
                if here != group:
                    if group:
                        yield from answers()
                    group, mine, asked, block = here, Rows(), Rows(), None
                part = batch.slice(a, b - a)
                vectors, x = part.column("vector").to_numpy(), _as_matrix(part.column("embedding"), here[1])
                if not keys[2][a]:
                    mine.add(vectors, part.column("first").to_numpy(), x)
                elif mine.n:
                    asked.add(vectors, x, part.column("reach").flatten().to_numpy().reshape(len(x), -1))
                    if asked.n >= QUERY_BLOCK:
                        yield from answers()
        if group:
            yield from answers()

    return dealt.repartition(len(these), "slot").sortWithinPartitions("slot", "dim", "query", "first").mapInArrow(run, "vector long, hits binary")


def merged_hits(hits: DataFrame, keep: int) -> DataFrame:
    """vector, hits: the ``keep`` best distinct vectors of each query over all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def rows() -> list[tuple]:
            return [(at, best(np.concatenate(held), keep).tobytes())] if held else []

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.int64()), pa.array([h for _, h in found], pa.binary())], names=["vector", "hits"])

        for batch in batches:
            found: list[tuple] = []
            for v, h in zip(batch.column(0).to_pylist(), batch.column(1)):
                if v != at:
                    found += rows()
                    at, held = v, []
                held.append(np.frombuffer(h.as_buffer(), HIT))
                if len(held) > 64:
                    held = [best(np.concatenate(held), keep)]
            yield out(found)
        yield out(rows())

    n = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hits.repartition(n, "vector").sortWithinPartitions("vector").mapInArrow(run, "vector long, hits binary")


def answered(candidates: DataFrame, queries: DataFrame, total: int, axes_of: dict[int, list[int]], tables: int, keep: int) -> DataFrame:
    """vector, other, score: the ``keep`` best distinct vectors of each query, block after block in passes."""
    spark = candidates.sparkSession
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(total / CANDIDATE_BLOCK), min(cores, math.ceil(total / LEAST_BLOCK)))
    found, step = None, max(PASS, cores)
    for low in range(0, blocks, step):
        new = ranked_blocks(candidates, queries, blocks, range(low, min(blocks, low + step)), axes_of, tables, keep)
        before, found = found, scratch.written(merged_hits(new.unionByName(found) if found is not None else new, keep), "ann-hits")
        if before is not None and (files := before.inputFiles()):
            scratch.delete(spark, files[0].rpartition("/")[0])
        del new, before
        scratch.free_shuffles(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scores([(v, int(h["vector"]), float(h["score"])) for v, raw in zip(batch.column(0).to_pylist(), batch.column(1)) for h in np.frombuffer(raw.as_buffer(), HIT)])

    return found.mapInArrow(run, "vector long, other long, score double")


def _scores(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["vector", "other", "score"])


def nearest_neighbours(table: DataFrame, query_every: int = 20, nearest: int = NEAREST, tables: int = TABLES, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row whose id is divisible by ``query_every``.

    Nearness is the inner product of the original vectors in double precision,
    largest first, ties to the smaller id.  Null ids, and vectors that are null,
    empty, zero or hold null or non-finite components, take no part; vectors of
    other lengths are not candidates; rows of one id are never candidates of
    each other, and equal rows count once.  A query with fewer found than wanted
    is searched for again among all vectors, in blocks, so that it gets all that
    there are.  ``probes`` of a table are by default :func:`probes_of` the
    number of distinct vectors.  Other columns are ignored.
    """
    spark = table.sparkSession
    keep = nearest + 1
    kind = "array<float>" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    finite = F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(F.col("embedding"), lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding")).where("vec_id is not null and size(embedding) > 0").where(finite)
    seed = 0
    while True:
        named = rows.select(F.xxhash64("embedding", F.lit(seed)).alias("vector"), F.xxhash64("embedding", F.lit(~seed)).alias("proof"), "vec_id", "embedding")
        vectors = scratch.written(distinct_vectors(named, nearest, query_every), "ann-vectors")
        if not vectors.groupBy("vector").count().where("count > 1").head(1):
            break
        seed += 1  # two vectors shared a fingerprint
    rows, vectors = named, vectors.drop("proof")
    scratch.free_shuffles(spark)
    sizes = {r.dim: r["count"] for r in vectors.groupBy("dim").count().collect()}  # one row for each length of vectors
    total, axes_of = sum(sizes.values()), {dim: polytopes(n, dim) for dim, n in sizes.items()}
    flat = vectors.select("vector", "dim", F.element_at("ids", 1).alias("first"), "embedding", "queried")
    asked = with_reach(flat.where("queried").drop("queried"), tables, axes_of, {dim: probes or probes_of(n) for dim, n in sizes.items()})
    asked = scratch.written(asked, "ann-asked")
    found = scratch.written(answered(flat, asked, total, axes_of, tables, keep), "ann-found")

    per_query = found.groupBy("vector").agg(F.count("*").alias("found"))
    short = scratch.written(flat.where("queried").drop("queried").join(per_query.where(F.col("found") >= keep), "vector", "left_anti"), "ann-short")
    if short.head(1):
        again = answered(flat, short.withColumn("reach", F.array(F.lit(0.0).cast("float"))), total, axes_of, 0, keep)
        found = scratch.written(found.join(short, "vector", "left_anti").unionByName(again), "ann-all")

    # What a vector is nearest to, by rows: at most keep * keep; its queries, however many, each leave themselves out.
    hits = found.join(vectors.select(F.col("vector").alias("other"), "ids"), "other").select("vector", "score", F.explode("ids").alias("vec_id"))
    near = scratch.written(hits.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near")), "ann-near")
    scratch.free_shuffles(spark)
    queries = rows.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest)
    return queries.join(near, "vector").select("query_id", F.posexplode(others).alias("k", "x")).select("query_id", (F.col("k") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
