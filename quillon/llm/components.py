"""Connected components of an edge table, by alternating large-star and small-star steps.

Both steps are grouped minima and equi-joins over edges, so nothing is collected. A hub's edges meet as a partial
minimum; the minima are written before they are joined, so that the join reads two plain shuffles, which Spark splits
where a hub makes one partition large (or broadcasts, while the minima are small). Each round is written to the shared
folder, which cuts the lineage, and the round before is deleted. Rounds grow with the logarithm of the longest path;
each split of the edges is first thinned to a spanning forest of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store

#: Most edges that one union-find of thinned() holds.
FOREST = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges a-b form a spanning forest."""
    names, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(names)))
    keep = np.zeros(len(a), dtype=bool)
    for k, (x, y) in enumerate(zip(back[: len(a)].tolist(), back[len(a) :].tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[k] = True
    return keep


def thinned(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            a, b = t.column(0).to_numpy(), t.column(1).to_numpy()
            k = forest(a, b)
            return pa.RecordBatch.from_arrays([pa.array(a[k]), pa.array(b[k])], names=["a", "b"])

        for x in batches:
            held.append(x)
            n += x.num_rows
            if n >= FOREST:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """edges: a long, b long, not null. Gives node, root for each node of an edge: root is the smallest node that it is connected with."""
    now = store(thinned(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "edges")
    state = None
    while True:
        # large star: every neighbour above u joins the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "near")
        large = store(both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        # small star: u and its neighbours below it join the smallest of them
        low = store(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        last, now = now, store(small.where("a <> b").distinct(), "edges")
        discard(last, near, large, low)
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_distinct("a").alias("d")).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
