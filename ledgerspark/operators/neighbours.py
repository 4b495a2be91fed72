"""Nearest neighbours of rows among themselves, by a forest of random projection trees with an exact re-rank.

A tree's upper levels come from a bounded sample of the rows and are broadcast; they deal the rows to at most UPPER
leaves, whose tasks go on splitting at exact medians down to LEAF rows and compare all pairs there. Each row keeps its
nearest of each tree, and of all trees together the k nearest by exact distance. Up to LEAF rows the result is exact;
beyond, tests measure its recall against brute force. Work and shuffle grow with the rows times the trees.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

TREES, LEAF, UPPER = 8, 512, 1024
SAMPLE = 1 << 16  # rows that the upper levels are built from, at most about


class Tree:
    """Random projections that halve a sample, level by level; rows fall to one of 2**depth leaves."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        nodes = 2**depth - 1
        self.depth, self.way, self.cut = depth, rng.normal(size=(nodes, sample.shape[1])), np.zeros(nodes)
        at = np.zeros(len(sample), np.int64)
        for level in range(depth):
            along = (sample * self.way[at]).sum(1) if len(sample) else np.zeros(0)
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                own = along[at == node]
                self.cut[node] = np.median(own) if len(own) else 0.0
            at = 2 * at + 1 + (along > self.cut[at])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + ((x * self.way[at]).sum(1) > self.cut[at])
        return at - (2**self.depth - 1)


def within(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, other row, squared distance: the k nearest of each row, among all."""
    k = min(k, len(x) - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    square = (x * x).sum(1)
    rough = square[:, None] + square - 2 * (x @ x.T)
    np.fill_diagonal(rough, np.inf)
    other = np.argpartition(rough, k - 1, axis=1)[:, :k].ravel()
    row = np.repeat(np.arange(len(x)), k)
    return row, other, ((x[row] - x[other]) ** 2).sum(1)


def halves(x: np.ndarray, rng) -> list[np.ndarray]:
    """Row numbers in pieces of at most LEAF rows, cut at medians of random projections."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            out.append(own)
        else:
            order = np.argsort(x[own] @ rng.normal(size=x.shape[1]), kind="stable")
            todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


def nearest(points: DataFrame, k: int = 5, trees: int = TREES) -> DataFrame:
    """points: key (long), x (array of doubles of one length). key, place (from 1), other, distance: the k nearest other rows of
    each, ties by key. Rows with equal keys or vectors should be combined before."""
    points = points.select("key", "x")
    n = points.count()
    depth = min(int(math.log2(UPPER)), max(0, math.ceil(math.log2(max(n, 1) / (8 * LEAF)))))
    sample = np.zeros((0, 1))
    if depth:
        share = F.lit(min(1.0, SAMPLE / n) * (1 << 20))
        sample = np.array([r["x"] for r in points.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share).orderBy("key").select("x").collect()])  # about SAMPLE rows
    forest = points.sparkSession.sparkContext.broadcast([Tree(sample, depth, i) for i in range(trees if n > LEAF else 1)])

    def dealt(batches):
        for b in batches:
            keys, x = b.column(0), vectors(b.column(1))
            for i, tree in enumerate(forest.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i)), pa.array(tree.leaves(x)), keys, b.column(1)], ["tree", "leaf", "key", "x"])

    def compared(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        keys, x = t.column("key").to_numpy(), vectors(t.column("x").combine_chunks())
        rng = np.random.default_rng([int(t.column("tree")[0].as_py()), int(t.column("leaf")[0].as_py())])
        parts = [(own[r], own[o], d) for own in halves(x, rng) for r, o, d in [within(x[own], k)]]
        row, other, d = (np.concatenate(c) for c in zip(*parts))
        return pa.Table.from_pydict({"key": keys[row], "other": keys[other], "distance": np.sqrt(d)})

    found = points.mapInArrow(dealt, "tree long, leaf long, key long, x array<double>").groupBy("tree", "leaf").applyInArrow(compared, "key long, other long, distance double")
    found = found.groupBy("key", "other").agg(F.min("distance").alias("distance"))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("distance", "other"))).where(F.col("place") <= k)
    return written(found.select("key", "place", "other", "distance"), "neighbours")


def vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
