"""Connected components of a distributed edge list: alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, released, scratch


class UnionFind:
    """Over hashable nodes; the root of a set is its smallest node."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x] = root
            x = p
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a < b:
            a, b = b, a
        self.parent[a] = b
        return True


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what (a, b) connect; as many as there are nodes, at most."""
    sets = UnionFind()
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        sets.union(x, y)
    nodes = [x for x in sets.parent if sets.find(x) != x]
    return np.array(nodes, np.int64), np.array([sets.find(x) for x in nodes], np.int64)


def thin(edges: DataFrame) -> DataFrame:
    """A spanning forest of each partition's edges (a, b); flushed at a bounded number of edges."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            a, b = forest(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
                size += batch.num_rows
            if size > 1 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, thinned: bool = False) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of the component.

    Each round sends, for every node, one row for each neighbour, after the smallest neighbour is found with
    a map-side aggregate; the rounds are as many as the logarithm of the component's size, and each is
    written to the shared folder.
    """
    now = scratch((edges if thinned else thin(edges)).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = fingerprint(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(least, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = scratch(small, "edges")
        drop_scratch(now)
        now, before, mark = after, mark, fingerprint(after)
        if before == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.lit(0))).first()
    return row[0], row[1]
