"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors are put together first. Each tree splits the unit vectors by random directions;
of a few directions and quantiles the split with the least spill is taken, and vectors within
a margin of it go to both sides. A node stays a leaf if it is small, or if no split keeps
the spill low, as within a group of copies. The trees are fitted on a sample of at most about
``SAMPLE`` distinct vectors; every vector is put through them.

Leaves are compared in double precision, whole. A pair that meets in several leaves counts in
the first of them only: each vector carries its leaves, and pairs with an earlier common leaf
are told by one matrix product. A leaf of more than ``BLOCK`` vectors is dealt out in blocks,
each pair of blocks a task. What leaves a task is linear in its vectors: numbers of links, and
a star for each local component.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing, and neither do vectors of different lengths; equal vectors link; rows that
repeat are separate vectors; an empty table gives no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, unit
from .components import connected_components

COSINE = 0.95
TREES = 4
SAMPLE = 32_768
LEAF = 768
#: Sampled vectors in a leaf at least.
LEAF_SAMPLE = 16
BLOCK = 8_192
TILE = 2_048
#: Spill to both sides, in standard deviations of the projected distance of a pair at the threshold.
MARGIN = 0.5
DIRECTIONS = 4
QUANTILES = np.linspace(0.25, 0.75, 21)
MOST_SPILL = 0.4
MAX_DEPTH = 40


def usable(v: Column) -> Column:
    """Whether a vector can link at all."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Forest:
    """Split nodes of all trees, and numbered leaves with their estimated sizes."""

    def __init__(self, sample: np.ndarray, scale: float, cosine: float = COSINE, trees: int = TREES, seed: int = 3):
        self.rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.margin = MARGIN * np.sqrt(2 * (1 - cosine) / max(1, self.dim))
        self.scale = scale
        self.sizes: list[float] = []
        self.roots = [self.grow(sample, np.arange(len(sample)), 0) for _ in range(trees)]

    def grow(self, sample: np.ndarray, at: np.ndarray, depth: int):
        """A leaf's number, or (direction, cut, left, right)."""
        best = None
        if len(at) * self.scale > LEAF and len(at) >= 2 * LEAF_SAMPLE and depth < MAX_DEPTH:
            for r in self.rng.standard_normal((DIRECTIONS, self.dim)):
                r /= np.linalg.norm(r)
                p = np.sort(sample[at] @ r)
                cuts = np.quantile(p, QUANTILES)
                spill = np.searchsorted(p, cuts + self.margin, "right") - np.searchsorted(p, cuts - self.margin)
                cost = spill / len(p) + 0.2 * np.abs(QUANTILES - 0.5)
                i = int(cost.argmin())
                if spill[i] <= MOST_SPILL * len(p) and (best is None or cost[i] < best[0]):
                    best = cost[i], r, float(cuts[i])
        if best is None:
            self.sizes.append(len(at) * self.scale)
            return len(self.sizes) - 1
        _, r, cut = best
        p = sample[at] @ r
        return r, cut, self.grow(sample, at[p <= cut + self.margin], depth + 1), self.grow(sample, at[p >= cut - self.margin], depth + 1)

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of unit rows and their leaves, in order of both."""
        places, numbers = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        todo = [(root, np.arange(len(rows))) for root in self.roots]
        while todo:
            node, at = todo.pop()
            if isinstance(node, int):
                places.append(at)
                numbers.append(np.full(len(at), node, dtype=np.int32))
            elif len(at):
                r, cut, left, right = node
                p = rows[at] @ r[: rows.shape[1]]
                todo += [(left, at[p <= cut + self.margin]), (right, at[p >= cut - self.margin])]
        place, number = np.concatenate(places), np.concatenate(numbers)
        order = np.lexsort((number, place))
        return place[order], number[order]


def stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node of its component, given links i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compared(rows: np.ndarray, weight: np.ndarray, block: np.ndarray, place: np.ndarray, own: np.ndarray, leaf: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links of each row that this leaf owns, and each row's local component.

    ``place`` and ``own`` are the leaves of each row. ``block``: if it has two values, only rows
    of different blocks are compared.
    """
    n, u = len(rows), units(rows)
    earlier = own < leaf
    ids, column = np.unique(own[earlier], return_inverse=True)
    member = np.zeros((n, len(ids)), dtype=np.float32)
    member[place[earlier], column] = 1
    across = len(np.unique(block)) > 1
    links = np.zeros(n, dtype=np.int64)
    label = np.arange(n)
    for a in range(0, n, TILE):
        for b in range(a, n, TILE):
            x, y = slice(a, a + TILE), slice(b, b + TILE)
            hit = u[x] @ u[y].T >= cosine
            if across:
                hit &= block[x, None] != block[None, y]
            if a == b:
                np.fill_diagonal(hit, False)
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            now = stars(np.concatenate([i + a, np.arange(n)]), np.concatenate([j + b, label]), n)
            label = np.minimum(label, now)
            owned = hit & (member[x] @ member[y].T == 0) if len(ids) else hit
            links[x] += owned @ weight[y]
            if a != b:
                links[y] += owned.T @ weight[x]
    return links, label


def near_duplicates(vectors: DataFrame, *, cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = F.col("embedding")
    keyed = vectors.select("vec_id", "embedding", usable(v).alias("usable"), F.xxhash64(F.lit(1), v).alias("k1"), F.xxhash64(F.lit(2), v).alias("k2"))
    classes = keyed.where("usable").groupBy("k1", "k2").agg(F.any_value("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = scratch.keep(classes.withColumn("cid", F.monotonically_increasing_id()))

    n, longest = classes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    share = min(1.0, SAMPLE / max(1, n))
    picked = [r[0] for r in classes.where(unit(F.xxhash64("cid", F.lit(9))) < share).select("embedding").collect()]
    sample = np.zeros((len(picked), longest))
    for row, x in zip(sample, picked, strict=True):
        row[: len(x)] = x
    forest = Forest(units(sample), n / max(1, len(picked)), cosine, trees) if picked else None
    shared = spark.sparkContext.broadcast(forest)
    blocks = [max(1, int(-(-s // BLOCK))) for s in forest.sizes] if forest else []
    sizes = np.array(blocks, dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("embedding")
            lengths = np.diff(data.offsets.to_numpy())
            flat = data.flatten().to_numpy(zero_copy_only=False).astype("<f8" if data.type.value_type == pa.float64() else "<f4")
            starts = np.cumsum([0, *lengths])
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                data = flat[starts[at][:, None] + np.arange(length)]
                place, leaf = shared.value.leaves(units(data))
                ends = np.cumsum(np.bincount(place, minlength=len(at)))
                own = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(leaf))
                vecs = pa.array([x.tobytes() for x in data], pa.binary())
                cid, n = batch.column("cid").take(pa.array(at)), batch.column("n").take(pa.array(at))
                # A vector goes to its block's pair with every block of the leaf.
                b = sizes[leaf]
                mine = (cid.to_numpy()[place].astype("<u8") * np.uint64(2654435761) >> np.uint64(16)).astype(np.int64) % b
                copy = np.repeat(np.arange(len(place)), b)
                other = np.arange(len(copy)) - np.repeat(np.cumsum(b) - b, b)
                for i in range(0, len(copy), 8192):
                    c, o = copy[i : i + 8192], other[i : i + 8192]
                    of, m = pa.array(place[c]), mine[c]
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, (leaf[c], np.minimum(m, o).astype("<i4"), np.maximum(m, o).astype("<i4"), np.full(len(c), length, "<i4"), m.astype("<i4"))), own.take(of), cid.take(of), n.take(of), vecs.take(of)],
                        ["leaf", "i", "j", "dim", "block", "leaves", "cid", "n", "vec"],
                    )

    def compare(table: pa.Table) -> pa.Table:
        dim, cid = table["dim"][0].as_py(), table["cid"].to_numpy()
        data = b"".join(table["vec"].to_pylist())
        rows = np.frombuffer(data, dtype="<f4" if len(data) == 4 * dim * len(cid) else "<f8").reshape(len(cid), dim)
        leaves = table["leaves"].combine_chunks()
        own, place = leaves.flatten().to_numpy(), np.repeat(np.arange(len(leaves)), leaves.value_lengths().to_numpy())
        links, label = compared(rows, table["n"].to_numpy(), table["block"].to_numpy(), place, own, table["leaf"][0].as_py(), cosine)
        some, moved = np.nonzero(links)[0], np.nonzero(label != np.arange(len(label)))[0]
        ends = [pa.array(np.concatenate([cid[some], cid[moved]])), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(cid[label[moved]])]), pa.array(np.concatenate([links[some], np.zeros(len(moved), dtype=np.int64)]))]
        return pa.Table.from_arrays(ends, ["a", "b", "links"])

    dealt = classes.select("cid", "n", "embedding").mapInArrow(deal, "leaf int, i int, j int, dim int, block int, leaves array<int>, cid long, n long, vec binary")
    met = scratch.keep(dealt.groupBy("leaf", "i", "j", "dim").applyInArrow(compare, "a long, b long, links long"))
    roots = connected_components(met.where("b is not null").select("a", "b"), scratch).withColumnRenamed("node", "cid")
    links = met.where("links > 0").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    thin = scratch.keep(classes.select("cid", "k1", "k2", "rep", "n").join(roots, "cid", "left").join(links, "cid", "left"))
    least = scratch.keep(thin.where("root is not null").groupBy("root").agg(F.min("rep").alias("least")))
    named = thin.join(least, "root", "left").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    found = keyed.where("usable").drop("embedding").join(scratch.keep(named), ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    return found.unionAll(keyed.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long"), F.col("vec_id").alias("component_id")))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
