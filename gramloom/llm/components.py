"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import written


#: Edges that a task joins at once, and in all.
PART = 1 << 20


def _joined(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Each node of some edges with the smallest node that they connect it to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        # Of the two ends' roots the larger one moves to the smaller; then all jump to their root's root.
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while not np.array_equal(jump := root[root], root):
            root = jump
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same connections by at most one edge for each node of a stretch of edges."""
    a, b, n = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n >= PART:
            yield _joined(np.concatenate(a), np.concatenate(b))
            a, b, n = [], [], 0
    if n:
        yield _joined(np.concatenate(a), np.concatenate(b))


def contracted(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with what lies in one partition replaced by stars."""
    return edges.where(F.col("a") != F.col("b")).select("a", "b").mapInArrow(_local, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating stars: a node's neighbours move to its smallest neighbour.

    The large step takes all neighbours and moves the larger ones, the small step takes and moves
    the smaller ones. Minima are found by partial aggregation, so a node of many neighbours is no
    burden; the join back splits by adaptive skew handling.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(least, "a")
    moved = joined.where(F.col("b") > F.col("a")) if large else joined
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by its smallest node.

    Each partition joins its own edges, which leaves at most one edge for each of its nodes. What is left of up to ``PART`` edges is
    joined by one task (16 MB); more go through alternating large and small stars. Each round's edges are a table in the shared folder, so plans
    stay short. Ends when a round changes no edge, which is after some log(n)**2 rounds at most.
    """
    edges = written(contracted(edges))
    if edges.count() <= PART:
        edges = written(contracted(edges.coalesce(1)))
    else:
        before = None
        while True:
            edges = written(_star(_star(contracted(edges), True), False).distinct())
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
