"""Exact Jaccard join of documents on word shingles, and the components of its links.

1. A document's set of shingles has a 64-bit fingerprint, its node; equal sets
   are one node from then on, however many documents share it.  A second
   fingerprint shows whether two sets share a node; if so, others are drawn.
2. Sets of similarity ``percent`` or more share a shingle among the first
   n - ceil(percent * n) + 1 of each under one order of all shingles, so only
   these are exchanged, in compact records, and only shingles of two nodes or
   more live on.  Any order is right; frequent shingles are put last.  What the
   copies of one text differ in then comes first, and a copy that differs in
   more than the similarity allows shows it by the places of what it shares.
3. Rounds join families of near copies, which would else be compared pair by
   pair: in each group of nodes with a common shingle those of other components
   are paired with the group's most central node of about their size (a number
   linear in the group), pairs are verified, components merged, and groups in
   which something merged go on with the next most central node.
4. Groups that still hold several components go through R-trees over count
   vectors, which keep the cross-component pairs whose summed coordinate minima
   allow the similarity.  A pair inside one component cannot change the result
   and is never made; the largest component of a group is never compared with itself.
5. Pairs must also pass the same bound over many more groups of tokens (a fine
   point, sparse), and only then are their texts fetched and verified.

Every linked pair of different components is thus found: the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .buckets import SCHEMA, by_bucket, dealt, how_many
from .components import components
from .countrtree import GROUPS, CountForest, fine_bound, fine_point, needed, point
from .idfilter import likely
from .textarrays import U64, constants, mix, shingle_sets, text_groups

PERCENT, WIDTH = 80, 5
ORDER = constants(1, 301)[0]
POSTING = np.dtype([("token", "<u8"), ("node", "<u8"), ("n", "<u4"), ("rank", "<u2")])
FLUSH = 1 << 20
#: Tokens of more nodes than FREQUENT come last in the order; so many of them are sent to every task at most (16 bytes each).
FREQUENT, FREQUENT_KEPT = 16, 500_000
#: Postings of a frequent token that meet in one task, about.
PART = 4096
#: Rounds of pairs with central nodes; what they leave is for the R-trees.
ROUNDS = 4
#: Nodes that one task compares others with; a larger group is compared block by block.
BLOCK = 1500


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _node(tokens: np.ndarray, seed: int = 0) -> int:
    """Fingerprint of a set, never 0."""
    salt = (len(tokens) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & (1 << 64) - 1
    return int(mix(np.add.reduce(mix(tokens ^ ORDER ^ U64(seed)), keepdims=True) ^ U64(salt))[0] | U64(1))


def feature_table(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, n, node (null for an empty set), proof (a second fingerprint), point and fine point of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in text_groups(batch.column("text")):
                sets = shingle_sets(group.lower().words(), WIDTH)
                nodes, proofs = (np.array([_node(s, k) if len(s) else 0 for s in sets], U64).view(np.int64) for k in (seed, ~seed & 0xFFFF))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(group.first, len(group)), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, mask=nodes == 0), pa.array(proofs), pa.array([point(s).tobytes() for s in sets], pa.binary()), pa.array([fine_point(s).tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "n", "node", "proof", "point", "fine"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, node long, proof long, point binary, fine binary")


def _short(token: np.ndarray, buckets: int) -> np.ndarray:
    """What frequencies are counted by: bucket and low 32 bits.  Tokens that share it count as one, which only moves them in the order."""
    return ((token >> U64(32)) % U64(buckets)) << U64(32) | token & U64(0xFFFFFFFF)


class Frequent:
    """The frequent tokens, and into how many parts to deal the postings of each."""

    def __init__(self, short: np.ndarray, nodes: np.ndarray, buckets: int):
        order = np.argsort(short)
        self.short, self.parts, self.buckets = short[order], -(-nodes[order] // PART), buckets

    def find(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens are frequent, and the number of parts of each."""
        if not len(self.short):
            return np.zeros(len(token), bool), np.ones(len(token), np.int64)
        short = _short(token, self.buckets)
        at = np.minimum(np.searchsorted(self.short, short), len(self.short) - 1)
        often = self.short[at] == short
        return often, np.where(often, self.parts[at], 1)


def frequent_tokens(docs: DataFrame, seed: int = 0) -> Frequent:
    """Tokens that more than FREQUENT nodes have, at most FREQUENT_KEPT of them.

    Counted over whole sets of all documents, four bytes a token.  Where there
    are more such tokens than are kept, the limit of the count is raised; what is
    in the order's front part then changes, not the result.
    """
    buckets = how_many(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, sent = [], 0, set()

        def flush() -> pa.RecordBatch:
            short = _short(np.concatenate(held), buckets)
            return dealt((short & U64(0xFFFFFFFF)).astype("<u4"), (short >> U64(32)).astype(np.int64), buckets)

        for batch in batches:
            for group in text_groups(batch.column("text")):
                for tokens in shingle_sets(group.lower().words(), WIDTH):
                    if not len(tokens) or (node := _node(tokens, seed)) in sent:
                        continue
                    sent.add(node)
                    held.append(tokens)
                    total += len(tokens)
            if total >= 4 * FLUSH:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    def add(bucket: int, low: np.ndarray) -> Iterator[pa.RecordBatch]:
        low = np.sort(low)
        begin = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        n = np.diff(np.r_[begin, len(low)])
        often = n > FREQUENT
        short = low[begin][often].astype(np.int64) | bucket << 32
        yield pa.RecordBatch.from_arrays([pa.array(short), pa.array(n[often])], names=["short", "n"])

    counted = scratch.written(by_bucket(docs.mapInArrow(count, SCHEMA), np.dtype("<u4"), add, "short long, n long", with_bucket=True), "ngram-frequent")
    least = FREQUENT
    while counted.where(F.col("n") > least).count() > FREQUENT_KEPT:
        least *= 2
    kept = counted.where(F.col("n") > least).toArrow()
    return Frequent(kept.column("short").to_numpy().view(U64), kept.column("n").to_numpy(), buckets)


def posting_blobs(docs: DataFrame, percent: int, shared: Broadcast, seed: int = 0) -> DataFrame:
    """Prefix postings of all nodes; a node that a task has already sent is not sent again.

    The postings of a frequent token are dealt into parts by node.
    """
    buckets = how_many(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, sent, frequent = [], 0, set(), shared.value

        def flush() -> pa.RecordBatch:
            records = np.concatenate(held)
            _, parts = frequent.find(records["token"])
            part = mix(records["node"]) % parts.astype(U64)
            return dealt(records, (mix(records["token"] ^ part * ORDER) % U64(buckets)).astype(np.int64), buckets)

        for batch in batches:
            for group in text_groups(batch.column("text")):
                sets = [s for s in shingle_sets(group.lower().words(), WIDTH) if len(s)]
                if not sets:
                    continue
                every = np.concatenate(sets)
                orders = np.split(mix(every ^ ORDER) >> U64(1) | frequent.find(every)[0].astype(U64) << U64(63), np.cumsum([len(s) for s in sets[:-1]]))
                for tokens, order in zip(sets, orders):
                    if (node := _node(tokens, seed)) in sent:
                        continue
                    sent.add(node)
                    p = prefix_length(len(tokens), percent)
                    first = np.argpartition(order, p - 1)[:p]
                    first = first[np.argsort(order[first])]
                    r = np.empty(p, POSTING)
                    r["token"], r["node"], r["n"], r["rank"] = tokens[first], node, len(tokens), np.minimum(np.arange(p), 65535)
                    held.append(r)
                    total += p
            if total >= FLUSH:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, SCHEMA)


LIVE = "token long, node long, n long, rank int, company long, other long"


def live_postings(records: np.ndarray, frequent: Frequent, percent: int) -> Iterator[pa.RecordBatch]:
    """Postings of the tokens of three nodes or more, each with their number (in its part, for a frequent token), and the pairs (node, other) of groups of two.

    A pair that shares as much as it must does so from its first common token
    on, so in that token's group the places of both allow it; others are left out.
    """
    records = records[np.lexsort((records["node"], records["token"]))]
    token, node = records["token"], records["node"]
    records = records[np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]]
    token = records["token"]
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
    company = np.repeat(np.diff(begin), np.diff(begin))
    parted = frequent.find(token)[1] > 1
    twos = begin[:-1][(np.diff(begin) == 2) & ~parted[begin[:-1]]]
    a, b = records[twos], records[twos + 1]
    n, m, k, r = (x.astype(np.int64) for x in (a["n"], b["n"], a["rank"], b["rank"]))
    need = needed(n, m, percent)
    able = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (n - k >= need) & (m - r >= need)
    pair = np.unique(np.stack([a["node"][able].view(np.int64), b["node"][able].view(np.int64)], 1), axis=0)
    live = (company > 2) | parted
    records, company = records[live], company[live]
    names = ["token", "node", "n", "rank", "company", "other"]
    for low in range(0, len(records), 100_000):
        part = records[low : low + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[c].astype(k)) for c, k in (("token", np.int64), ("node", np.int64), ("n", np.int64), ("rank", np.int32))] + [pa.array(company[low : low + 100_000]), pa.nulls(len(part), pa.int64())], names=names
        )
    nulls = lambda kind: pa.nulls(len(pair), kind)
    yield pa.RecordBatch.from_arrays([nulls(pa.int64()), pa.array(pair[:, 0]), nulls(pa.int64()), nulls(pa.int32()), nulls(pa.int64()), pa.array(pair[:, 1])], names=names)


def _fits(n: str, m: str, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _enough(n: Column, rank: Column, m: Column, percent: int) -> Column:
    """Whether what a set of n tokens has from this place on is the least that it must share with one of m tokens."""
    return (100 + percent) * (n - rank) >= percent * (n + m)


def _band(n: str, percent: int) -> Column:
    """Sizes that fit lie in one band or in adjacent ones (bands are a little wider than need be, for rounding)."""
    return F.floor(F.log(n) / math.log(100.01 / percent)).cast("int")


def proposals(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b of components x, y) of the members of groups with their most central node of about their size, and those centres.

    As in :func:`live_postings`, pairs that their places rule out are left out.
    """
    banded = members.withColumn("band", _band("n", percent))
    top = banded.where("central >= 0").groupBy("token", "band").agg(F.max(F.struct("central", "node", "n", "rank", "component")).alias("top"))
    centres = top.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("top.node").alias("centre"), F.col("top.n").alias("cn"), F.col("top.rank").alias("crank"), F.col("top.component").alias("y"))
    able = _fits("n", "cn", percent) & _enough(F.col("n"), F.col("rank"), F.col("cn"), percent) & _enough(F.col("cn"), F.col("crank"), F.col("n"), percent)
    pairs = banded.join(centres, ["token", "band"]).where((F.col("component") != F.col("y")) & able)
    turned = F.col("node") > F.col("centre")
    pairs = pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"), F.when(turned, F.col("y")).otherwise(F.col("component")).alias("x"), F.when(turned, F.col("component")).otherwise(F.col("y")).alias("y"))
    return pairs, top.select("top.node").distinct()


def tree_pairs(members: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """Cross-component pairs (a, b, x, y) of nodes that share a token and pass the R-trees' bounds.

    ``members``: token, node, n, rank (of the token in the node's order),
    component, doc.  A row whose place rules out every partner in its group goes
    first.  A group of more than BLOCK nodes is dealt by size band into blocks;
    its nodes outside the largest component meet all blocks of their band and
    the adjacent ones.
    """
    spark = members.sparkSession
    per_group = lambda df: df.groupBy("token").agg(F.count("*").alias("m"), F.min("component").alias("p"), F.max("component").alias("q"), F.min("n").alias("least")).where("p != q")
    enough = _enough(F.col("n"), F.col("rank"), F.col("least"), percent) & (100 * (100 + percent) * (F.col("n") - F.col("rank")) >= percent * (100 + percent) * F.col("n"))
    able = members.join(per_group(members).select("token", "least"), "token").where(enough).select("token", "node", "n", "rank", "component", "doc")
    able = scratch.written(able, "ngram-able")
    groups = scratch.written(per_group(able).select("token", "m"), "ngram-groups")
    kept = able.join(groups, "token").withColumn("band", _band("n", percent))
    columns = ["token", "band", "block", "target", "query", "node", "n", "rank", "component", "doc"]
    yes, no = F.lit(True), F.lit(False)
    parts = kept.where(F.col("m") <= BLOCK).withColumn("band", F.lit(0)).select("token", "band", F.lit(0).alias("block"), yes.alias("target"), yes.alias("query"), *columns[5:])
    if groups.where(F.col("m") > BLOCK).head(1):
        hot = kept.where(F.col("m") > BLOCK)
        main = hot.groupBy("token", "component").count().groupBy("token").agg(F.max_by("component", "count").alias("main"))
        blocks = hot.groupBy("token", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        targets = hot.join(blocks, ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        asking = hot.join(main, "token").where("component != main").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
        queries = asking.join(blocks, ["token", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        parts = parts.unionByName(targets.withColumns({"target": yes, "query": no}).select(*columns)).unionByName(queries.withColumns({"target": no, "query": yes}).select(*columns))
    some = likely(features.select("node", "doc_id", "point"), "doc_id", able.select("doc"))
    pointed = parts.join(wanted(some, able.select("node", "doc").distinct(), "point"), "node").drop("doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            token, band, block, node, n, rank, component = (table.column(c).to_numpy() for c in ("token", "band", "block", "node", "n", "rank", "component"))
            target, query = (table.column(c).to_numpy(zero_copy_only=False) for c in ("target", "query"))
            fresh = np.r_[False, (token[1:] != token[:-1]) | (band[1:] != band[:-1]) | (block[1:] != block[:-1])]
            points = np.frombuffer(b"".join(table.column("point").to_pylist()), np.uint8).reshape(-1, GROUPS)
            forest = CountForest(points, n, np.cumsum(fresh), n - rank, component)
            left, right = forest.pairs(percent, target, query)
            turned = node[left] > node[right]
            left, right = np.where(turned, right, left), np.where(turned, left, right)
            found = np.unique(np.stack([node[left], node[right], component[left], component[right]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "x", "y"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 20_000:
                continue
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy() for c in ("token", "band", "block")]
            last = int(np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])[-1])
            if last:
                yield from settle(table.slice(0, last))
                held, rows = table.slice(last).to_batches(), table.num_rows - last
        if rows:
            yield from settle(pa.Table.from_batches(held))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pointed.repartition(n, "token", "band", "block").sortWithinPartitions("token", "band", "block").mapInArrow(run, "a long, b long, x long, y long")


def wanted(features: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """node and ``column`` of each of ``nodes`` (node, doc), once."""
    found = features.select("node", F.col("doc_id").alias("doc"), column).join(nodes, ["node", "doc"])
    return found.select("node", column).dropDuplicates(["node"])


def _placed(pairs: DataFrame, first_doc: DataFrame) -> DataFrame:
    """Pairs with u, na, v, nb: smallest documents and sizes of their nodes; a node without a component is its own."""
    side = lambda node, doc, n: first_doc.select(F.col("node").alias(node), F.col("doc").alias(doc), F.col("n").alias(n))
    return pairs.join(side("a", "u", "na"), "a").join(side("b", "v", "nb"), "b").withColumn("x", F.coalesce("x", "u")).withColumn("y", F.coalesce("y", "v"))


def refined(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, u, v, na, nb, x, y) that pass the bound of their fine points."""
    nodes = pairs.select(F.col("a").alias("node"), F.col("u").alias("doc")).unionByName(pairs.select(F.col("b").alias("node"), F.col("v").alias("doc"))).distinct()
    some = likely(features.select("node", "doc_id", "fine"), "doc_id", pairs.select(F.explode(F.array("u", "v"))))
    fine = scratch.written(wanted(some, nodes, "fine"), "ngram-fine")
    scratch.free_shuffles(pairs.sparkSession)
    both = pairs.join(fine.select(F.col("node").alias("a"), F.col("fine").alias("fa")), "a").join(fine.select(F.col("node").alias("b"), F.col("fine").alias("fb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = needed(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent).tolist()
            fa, fb = batch.column("fa"), batch.column("fb")
            read = lambda c, i: np.frombuffer(c[i].as_buffer(), "<u2")
            kept = pa.array([i for i, least_i in enumerate(least) if fine_bound(read(fa, i), read(fb, i)) >= least_i], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(kept) for c in ("u", "v", "x", "y")], names=["u", "v", "x", "y"])

    return both.select("na", "nb", "fa", "fb", "u", "v", "x", "y").mapInArrow(run, "u long, v long, x long, y long")


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) between the components x, y of those pairs of documents (u, v, x, y) whose sets reach the similarity."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = scratch.written(likely(docs, "doc_id", ids).join(ids.distinct(), "doc_id", "left_semi").repartition(n, "doc_id").dropDuplicates(["doc_id", "text"]), "ngram-texts")
    scratch.free_shuffles(spark)
    with_u = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    both = with_u.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v").select("x", "y", "text_u", "text_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, at = [], 0
            left = (s for g in text_groups(batch.column("text_u")) for s in shingle_sets(g.lower().words(), WIDTH))
            right = (s for g in text_groups(batch.column("text_v")) for s in shingle_sets(g.lower().words(), WIDTH))
            for p, q in zip(left, right):
                shared = len(np.intersect1d(p, q, assume_unique=True))
                if len(p) and len(q) and 100 * shared >= percent * (len(p) + len(q) - shared):
                    keep.append(at)
                at += 1
            kept = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("x").take(kept), batch.column("y").take(kept)], names=["u", "v"])

    return both.mapInArrow(run, "u long, v long").distinct()


def _moved(df: DataFrame, merged: DataFrame | None) -> DataFrame:
    """``df`` with the column component as ``merged`` (node: an old component, component) has it now."""
    if merged is None:
        return df
    return df.withColumnRenamed("component", "_old").join(merged.select(F.col("node").alias("_old"), F.col("component").alias("_new")), "_old", "left").withColumn("component", F.coalesce("_new", "_old")).withColumn("_changed", F.col("_new").isNotNull()).drop("_old", "_new")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Texts are whole, lower-cased in A-Z, in sets of distinct five-word shingles;
    1 to 4 words are one shingle.  Null, empty and blank texts have an empty set
    and are their own component.  Rows with a null id link nothing and have a
    null component.  Rows that share an id are one vertex of the graph for each
    distinct set, under that id; repeated rows are returned as often as they
    occur; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seed = 0
    while True:
        features = scratch.written(feature_table(docs, seed), "ngram-features")
        first_doc = scratch.written(features.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n"), F.min("proof").alias("p"), F.max("proof").alias("q")), "ngram-nodes")
        if not first_doc.where("p != q").head(1):
            break
        seed += 1  # two sets had one node
    first_doc = first_doc.select("node", "doc", "n")
    known_docs = docs.where("doc_id is not null")
    shared = spark.sparkContext.broadcast(frequent_tokens(known_docs, seed))
    scratch.free_shuffles(spark)
    live = scratch.written(by_bucket(posting_blobs(known_docs, percent, shared, seed), POSTING, lambda records: live_postings(records, shared.value, percent), LIVE), "ngram-live")
    scratch.free_shuffles(spark)

    twos = live.where("other is not null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("y"))
    live = live.where("other is null").drop("other")
    weights = live.groupBy("node").agg(F.sum("company").alias("central"))
    members = scratch.written(live.drop("company").join(first_doc.select("node", "doc").join(weights, "node"), "node").withColumn("component", F.col("doc")), "ngram-members")
    tested: list[DataFrame] = []

    def merged(proposed: DataFrame) -> DataFrame | None:
        """node, component of the components that links among the proposed pairs make one; None if there are none."""
        for before in tested:
            proposed = proposed.join(before.select("a", "b"), ["a", "b"], "left_anti")
        proposed = scratch.written(_placed(proposed.distinct(), first_doc), "ngram-proposed")
        tested.append(proposed)
        scratch.free_shuffles(spark)
        with scratch.passing() as owner:  # texts and fine points of the pairs
            close = scratch.written(refined(proposed, features, percent), "ngram-close")
            scratch.free_shuffles(spark)
            edges = verified(close, known_docs, percent)
            with scratch.owned_by(owner):
                edges = scratch.written(edges, "ngram-edges")
        scratch.free_shuffles(spark)
        return components(edges) if edges.head(1) else None

    active, moves = members, []
    for _ in range(ROUNDS):
        proposed, centres = proposals(active, percent)
        centres = scratch.written(centres, "ngram-centres")
        if (found := merged(proposed if moves else proposed.unionByName(twos))) is None:
            break
        moves.append(found)
        central = F.when(F.col("_used").isNotNull(), -1).otherwise(F.col("central"))
        after = _moved(members.drop("changed"), found).join(centres.withColumn("_used", F.lit(1)), "node", "left").withColumn("central", central).drop("_used")
        groups = after.groupBy("token").agg(F.count("*").alias("m"), F.min("component").alias("p"), F.max("component").alias("q"), F.max("_changed").alias("changed"))
        members = scratch.written(after.drop("_changed").join(groups.where("p != q").select("token", "changed"), "token"), "ngram-members")
        active = members.where("changed")
    if (found := merged(tree_pairs(members, features, percent))) is not None:
        moves.append(found)

    placed = first_doc.select("node", F.col("doc").alias("component"))
    for found in moves:
        placed = _moved(placed, found).drop("_changed")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return features.join(placed, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
