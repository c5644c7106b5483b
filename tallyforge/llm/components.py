"""Connected components by contraction, in DataFrames.

Each round: every partition replaces its edges by a spanning forest of them (union-find over
what it holds), every node points to the node of least hash in its closed neighbourhood,
pointers are jumped once, and the edges are contracted to the nodes pointed to. A random
order per round makes a constant fraction of the nodes vanish each time, so chains end after
logarithmically many rounds. The rounds' pointers are composed at the end. Nothing but
row counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges up to which one task may finish the job by itself.
SMALL_EDGES = 10_000


def find(parent: dict, x):
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while (up := parent.get(x, x)) != root:
        parent[x] = root
        x = up
    return root


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the nodes of all edges of this partition: (node, root), roots left out."""
    parent: dict = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(parent, a), find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 1 << 16):
        some = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(parent, x) for x in some], pa.int64())], ["a", "b"])


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two long columns); equal roots, one component.

    Null ends and loops are ignored; repeated edges and either direction make no difference.
    """
    a, b = edges.columns
    clean = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b"))
    now = scratch.keep(clean.mapInArrow(forest, "a long, b long"))
    maps: list[DataFrame] = []
    while (n := now.count()) > SMALL_EDGES:
        ordered = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        both = now.select("a", ordered("b").alias("b")).unionAll(now.select(F.col("b").alias("a"), ordered("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b"))
        points = scratch.keep(least.select(F.col("a").alias("node"), F.least(F.col("b"), ordered("a"))["x"].alias("up")))
        jump = points.select(F.col("node").alias("up"), F.col("up").alias("top"))
        points2 = scratch.keep(points.join(jump, "up", "left").select("node", F.coalesce("top", "up").alias("up")))
        scratch.drop(points)
        ups = lambda c: points2.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        shrunk = now.join(ups("a"), "a").join(ups("b"), "b").where("a_up <> b_up").select("a_up", "b_up")
        after = scratch.keep(shrunk.mapInArrow(forest, "a long, b long"))
        scratch.drop(now)
        maps.append(points2)
        now = after
    # At most SMALL_EDGES edges are left: one task joins them up.
    last = now.coalesce(1).mapInArrow(forest, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = scratch.keep(last.unionAll(last.select("root", "root")).distinct())
    for points in reversed(maps):
        above = roots.select(F.col("node").alias("up"), "root")
        roots = scratch.keep(points.join(above, "up", "left").select("node", F.coalesce("root", "up").alias("root")))
    return roots
