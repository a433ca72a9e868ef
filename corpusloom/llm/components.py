"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: So many edges (16 bytes each) are settled by one task; more go through the steps.
ONE_TASK = 1 << 18


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(apart := np.flatnonzero(root[a] != root[b])):
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return nodes, nodes[root]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if held := list(batches):
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(u, v)], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (u, v longs).

    Each step joins edges with the least neighbour of a node; minima are
    combined before the shuffle and a hub's edges are split by the skew join.
    Steps are written to the shared folder, and only their counts and checksums
    reach the driver.  Up to ONE_TASK edges are one task's work instead: the plans
    of the steps would take more of the driver than their rows of the executors.
    Self-loops, repeated and reversed edges do no harm.
    """
    edges = scratch.written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    if edges.count() <= ONE_TASK:
        return scratch.written(edges.coalesce(1).mapInArrow(_in_one_task, "node long, component long"), "cc-one")
    before = None
    while (mark := _mark(edges)) != before:
        before = mark
        # Large star: what is larger than u and beside it moves to u's least neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = scratch.written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "cc-large")
        # Small star: u and what is smaller beside it move to the least of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = scratch.written(moved.where("u != v").distinct(), "cc-small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
