"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ROUNDS = 60
#: Links, of 16 bytes each, whose components one task finds; more of them take distributed rounds. The result is the same.
FEW = 200_000


def forest(links: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph with ``n`` nodes: it connects what ``links`` connect, with n - 1 links at most."""
    root = np.arange(n)
    i = np.concatenate([x for x, _ in links]) if links else np.empty(0, dtype=np.int64)
    j = np.concatenate([y for _, y in links]) if links else np.empty(0, dtype=np.int64)
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
        i, j = i[apart], j[apart]
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _in_one_task(e: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            node, root = forest([(at[: len(a)], at[len(a) :])], len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[node]), pa.array(nodes[root])], ["node", "root"])

    return cut(e.repartition(1).mapInArrow(run, "node bigint, root bigint"))


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """A row (node, root) for each node (bigint) of ``edges`` (a, b) that is not itself the smallest of its component.

    Up to ``few`` different links are solved in one task, which that number bounds. Beyond, large-star and small-star steps alternate: each hangs a node's larger neighbours, then its smaller ones, on the
    smallest node it sees, until only stars are left. A step is an aggregation, whose minima are built before the
    shuffle, and an equi-join that adaptive execution splits at hot nodes. Every round is cut to the shared folder; the
    driver sees two numbers a round.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    state = _state(e)
    if state[0] <= few:
        return _in_one_task(e)
    for _ in range(ROUNDS):
        if not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = cut(small.where("a != b").distinct())
        new = _state(e)
        if new == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new
    raise RuntimeError(f"components are not settled after {ROUNDS} rounds")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
