"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stash

FLUSH = 2_000_000  # edges that a task holds at most before it contracts them
SCHEMA = "a long, b long, m int"


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for every node of the edges that isn't the least itself."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts a task's edges to stars; m: whether that changed anything. Contracts whenever what it holds has doubled."""
    held, n, limit, merged = [], 0, FLUSH, False
    for batch in batches:
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
        n += batch.num_rows
        if n > limit:
            x, y, more = _contract(held)
            held, n, limit, merged = [[x, y]], len(x), max(FLUSH, 2 * len(x)), merged or more
    if n:
        x, y, more = _contract(held)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), merged or more, np.int32))], names=["a", "b", "m"])


def _contract(held: list) -> tuple[np.ndarray, np.ndarray, bool]:
    a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    x, y = star_forest(a, b)
    had = np.unique(np.column_stack((a, b)), axis=0)
    return x, y, not (len(had) == len(x) and (had[:, 0] == x).all() and (had[:, 1] == y).all())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b), root the least node reachable; stashed.

    Every task first contracts its own edges to stars, so that a node has one edge a task at most. Each round then brings
    the edges of a node together, contracts again, and moves nodes from their parent to its parent (a join that adaptive
    execution splits where very many share a parent), until nothing changes: as many rounds as the logarithm of the
    depth. Two figures a round reach the driver; tasks grow in number with the edges. An unfinished result is an error.
    """
    least = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_forest, SCHEMA), "cc")
    e, n = first, first.count()
    for _ in range(max_rounds):
        stars = stash(e.select("a", "b").repartition(max(least, 2 * n // FLUSH), "a").mapInArrow(_forest, SCHEMA), "cc")
        up = stars.groupBy(F.col("a").alias("p")).agg(F.min("b").alias("q"))
        after = stash(stars.join(up, F.col("b") == F.col("p"), "left").select("a", F.coalesce("q", "b").alias("b"), (F.col("m") + F.col("q").isNotNull().cast("int")).alias("m")), "cc")
        drop(stars, e)
        e = after
        state = e.agg(F.max("m").alias("m"), F.count(F.lit(1)).alias("n")).first()
        n = state["n"]
        if not state["m"]:
            break
    else:
        raise RuntimeError(f"components haven't settled after {max_rounds} rounds")
    pairs = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
