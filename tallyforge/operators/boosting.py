"""Gradient-boosted trees of all cards and groups at once, grown level by level from histograms.

Rows are weighted cells: a card, covariates, a weight ``n`` and sums of targets ``s``. They are binned by
weighted quantiles and packed into blocks of one card each (``packed``): two a card at least, and as many as
blocks of ``ROOM`` bytes take. For each level of a tree every task sums counts and gradients of its blocks by
card, target, node, column and bin, several columns in one pass (``learners.Layout``); these sums meet by card
and target, where the best split of each node is chosen. Only chosen splits, a few numbers a node, come to the
driver. So no task holds a card, and what is shuffled depends on blocks, targets and bins, not on tasks or on rows.

Fitted values are kept in the blocks and written every ``KEPT`` trees, so that plans and recomputation stay
short; the blocks before are discarded then. Rows that train nothing are scored by the trees (``scorer``, ``residuals``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import discard, stored_at
from .learners import BINS, Layout, chosen_split, sigmoid

#: Trees between two writings of the fitted values. A tree that is not in them is walked at every level of the next ones.
KEPT = 3
#: Sets of cards that are fitted beside each other: the small jobs of one leave room for those of another.
LANES = 3
#: Bytes of a block, as numbers in memory.
ROOM = 32 << 20
#: Rows that a task scores at once.
SCORED = 1 << 17
#: Least weight of a row in the logistic loss, as in the plain version.
LEAST_WEIGHT = 1e-6
#: Fitted values hardly get smaller, and blocks are read for every level.
PLAIN = {"compression": "none"}
PACKED = "card_a string, block int, keys binary, n binary, s binary, f binary"


@dataclass
class Boosting:
    """A fit: ``blocks`` with fitted values, ``edges`` by card and column, and, if asked for, the trees."""

    names: tuple[str, ...]
    settings: dict
    binary: bool
    blocks: DataFrame
    edges: dict[str, list[np.ndarray]]
    base: dict[str, np.ndarray]
    layout: Layout | None = None
    trees: dict[str, np.ndarray] = field(default_factory=dict)


def started(rows: DataFrame, names: tuple[str, ...], targets: list[str], *, binary: bool) -> tuple[dict, dict, dict]:
    """Per card the distinct quantiles of each column, the starting values and the number of rows, over the rows of weight above 0.

    One aggregate; its result has a row a card. Percentiles are exact, and count distinct values.
    """
    at = np.linspace(0, 1, BINS)[1:-1]
    shares = F.array(*[F.lit(float(p)) for p in at])
    found = rows.where("n > 0").groupBy("card_a").agg(
        F.sum("n").alias("n"), F.count("*").alias("rows"), *[F.percentile(F.col(c).cast("double"), shares, F.col("n")).alias(f"q_{i}") for i, c in enumerate(names)], *[F.sum(f"s_{t}").cast("double").alias(f"y_{i}") for i, t in enumerate(targets)]
    ).collect()
    edges = {r["card_a"]: [np.unique(np.array(r[f"q_{i}"])) for i in range(len(names))] for r in found}
    base = {}
    for r in found:
        mean = np.array([r[f"y_{i}"] for i in range(len(targets))]) / r["n"]
        if binary:
            mean = np.clip(mean, 1e-6, 1 - 1e-6)
            mean = np.log(mean / (1 - mean))
        base[r["card_a"]] = mean
    return edges, base, {r["card_a"]: r["rows"] for r in found}


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]).astype(np.uint8)


def numbered_blocks(sizes: dict[str, int], row_bytes: int) -> dict[str, tuple[int, int]]:
    """Per card the number of its first block and how many blocks it takes."""
    out, first = {}, 0
    for card in sorted(sizes):
        many = max(2, -(-sizes[card] * row_bytes // ROOM))
        out[card] = first, many
        first += many
    return out


def short(v: np.ndarray) -> bytes:
    """Numbers as bytes, one each if they are small whole ones; the first eight bytes say which."""
    small = v.astype(np.uint8) if len(v) and v.min() >= 0 and v.max() < 256 else None
    v = small if small is not None and np.array_equal(small, v) else v
    return f"{v.dtype.str:8}".encode() + v.tobytes()


def long(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=b[:8].decode().strip(), offset=8)


def packed(rows: DataFrame, names: tuple[str, ...], targets: list[str], edges: dict, base: dict, sizes: dict, layout: Layout) -> tuple[DataFrame, str]:
    """Blocks of rows of one card, and their path.

    A block has joint keys (a part's in one stretch), weights n, sums s and fitted values f (a target's in one stretch).
    ``rows``: card_a, names, n, ``s_<target>``.
    """
    known = rows.sparkSession.sparkContext.broadcast((edges, base, layout))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges, base, layout = known.value
        blocks: dict[tuple, list] = {}
        for pdf in batches:
            for (card, block), part in pdf.groupby(["card_a", "block"]):
                numbers = lambda columns: part[columns].to_numpy(dtype=float)  # noqa: B023, E731
                blocks.setdefault((card, block), []).append((layout.keys(binned(numbers(list(names)), edges[card])), numbers("n"), numbers([f"s_{t}" for t in targets]).T))
        while blocks:
            (card, block), parts = blocks.popitem()
            keys, n, s = (np.concatenate(v, axis=-1) for v in zip(*parts, strict=True))
            f = np.repeat(base[card][:, None], len(n), axis=1)
            yield pd.DataFrame([(card, block, keys.tobytes(), short(n), short(s.ravel()), f.tobytes())], columns=["card_a", "block", "keys", "n", "s", "f"])

    if not edges:
        return stored_at(rows.limit(0).mapInPandas(lambda batches: iter(()), PACKED), "blocks", **PLAIN)
    blocks = numbered_blocks(sizes, 2 * len(layout.parts) + 8 * (1 + 2 * len(targets)))
    first, many = (F.create_map(*[F.lit(x) for card, v in blocks.items() for x in (card, v[i])])[F.col("card_a")] for i in (0, 1))
    # A block is a partition, however small: AQE would merge them, and they are long to work on.
    fitted = rows.where(F.col("card_a").isin(*edges) & (F.col("n") > 0)).withColumn("block", (first + F.pmod(F.xxhash64(*names), many)).cast("int"))
    dealt = fitted.repartitionById(sum(v[1] for v in blocks.values()), F.col("block"))
    return stored_at(dealt.mapInPandas(run, PACKED), "blocks", **PLAIN)


def positions(layout: Layout, tree: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray | None:
    """Each row's place among the nodes of a level of one target's tree (node, 3); None if all are in the first. Below a node that was not split, rows keep to the left."""
    node = None
    for level in range(depth):
        go, first = None, (1 << level) - 1
        for q in range(1 << level):
            if (j := int(tree[first + q, 0])) >= 0:
                part, above = layout.above(j, int(tree[first + q, 1]))
                right = above.take(keys[part])
                if node is not None:
                    right &= node == q
                go = right if go is None else go | right
        if node is not None:
            node = node * node.dtype.type(2)
            if go is not None:
                node += go
        elif go is not None:
            node = go.astype(np.uint8 if depth < 8 else np.int32)
    return node


def leaf_values(tree: np.ndarray, depth: int) -> np.ndarray:
    """The value at each place of the deepest level: that of the last split on the way."""
    value = tree[:1, 2]
    for level in range(depth):
        first = (1 << level) - 1
        split = np.repeat(tree[first : 2 * first + 1, 0] >= 0, 2)
        value = np.where(split, tree[2 * first + 1 : 4 * first + 3, 2], np.repeat(value, 2))
    return value


def advance(f: np.ndarray, trees: np.ndarray, layout: Layout, keys: np.ndarray, rate: float, depth: int) -> np.ndarray:
    """Fitted values (target, row) with these trees (tree, target, node, 3) as well."""
    f = f.copy()
    for tree in trees:
        for g, own in enumerate(tree):
            values, node = rate * leaf_values(own, depth), positions(layout, own, keys, depth)
            f[g] += values[0] if node is None else values.take(node)
    return f


def added(f: np.ndarray, trees: np.ndarray, bins: np.ndarray, rate: float, depth: int) -> np.ndarray:
    """``advance`` for rows of bins, with fitted values by (row, target)."""
    layout = Layout([int(c.max(initial=0)) + 1 for c in bins.T])
    return advance(f.T, trees, layout, layout.keys(bins), rate, depth).T


@dataclass
class Shape:
    """What trees of all cards have in common: layout of the columns' bins, number of targets, settings, loss."""

    layout: Layout
    targets: int
    settings: dict
    binary: bool

    @property
    def offsets(self) -> np.ndarray:
        return self.layout.offsets

    @property
    def tree(self) -> tuple[int, int, int]:
        return self.targets, (2 << self.settings["depth"]) - 1, 3

    def empty(self) -> np.ndarray:
        tree = np.zeros(self.tree)
        tree[:, :, 0] = -1
        return tree

    def read(self, b) -> tuple[np.ndarray, np.ndarray]:
        """Joint keys and fitted values of a block."""
        return np.frombuffer(b.keys, dtype=np.uint16).reshape(len(self.layout.parts), -1), np.frombuffer(b.f).reshape(self.targets, -1)

    def added(self, f: np.ndarray, trees: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return advance(f, trees, self.layout, keys, self.settings["rate"], self.settings["depth"]) if len(trees) else f


def histograms(shape: Shape, keys: np.ndarray, n: np.ndarray, s: np.ndarray, f: np.ndarray, tree: np.ndarray, level: int) -> np.ndarray:
    """Counts, weights (logistic loss only) and gradients by target, kind, node of the level and bin."""
    nodes = 1 << level
    out = np.empty((shape.targets, 3 if shape.binary else 2, nodes, int(shape.offsets[-1])))
    # Where every row counts once, it needs no weight.
    count = None if n.dtype == np.uint8 and (n == 1).all() else n.astype(float)
    of = lambda v: v if count is None else count * v
    for g in range(shape.targets):
        if shape.binary:
            p = sigmoid(f[g])
            kinds = [count, of(np.maximum(p * (1 - p), LEAST_WEIGHT)), s[g] - of(p)]
        else:
            kinds = [count, s[g] - of(f[g])]
        out[g] = shape.layout.sums(list(keys), kinds, positions(shape.layout, tree[g], keys, level), nodes)
    return out


def best_splits(shape: Shape, v: np.ndarray) -> np.ndarray:
    """From one target's sums, for each node of a level: column (-1 for none), cut, value, values of the two children."""
    n, w, wy = v[0], v[-2], v[-1]
    offsets, leaf, nodes = shape.offsets, shape.settings["leaf"], len(n)
    out = np.full((nodes, 5), -1.0)
    for q in range(nodes):
        one = slice(0, int(offsets[1]))
        rows, mass, total = n[q, one].sum(), w[q, one].sum(), wy[q, one].sum()
        out[q, 2] = total / mass if mass > 0 else 0.0
        if rows < 2 * leaf or mass <= 0:
            continue
        # Running sums within each column; the last bin of a column is no cut.
        left = [np.concatenate([np.cumsum(u[q, a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]) for u in (n, w, wy)]
        ok = (left[0] >= leaf) & (rows - left[0] >= leaf) & (left[1] > 0) & (mass - left[1] > 0)
        ok[offsets[1:] - 1] = False
        gain = np.where(ok, left[2] ** 2 / np.where(ok, left[1], 1) + (total - left[2]) ** 2 / np.where(ok, mass - left[1], 1) - total**2 / mass, -1.0)
        best = chosen_split(gain)
        if best < 0:
            continue
        column = int(np.searchsorted(offsets, best, side="right")) - 1
        out[q] = column, best - offsets[column], out[q, 2], left[2][best] / left[1][best], (total - left[2][best]) / (mass - left[1][best])
    return out


def put(tree: np.ndarray, best: np.ndarray, level: int) -> bool:
    """Writes a level's splits into one target's tree (node, 3); whether there are any."""
    if level == 0:
        tree[0, 2] = best[0, 2]
    for q in np.flatnonzero(best[:, 0] >= 0):
        node = (1 << level) - 1 + q
        if level and tree[(node - 1) // 2, 0] < 0:
            # Rows of a node that was not split.
            best[q, 0] = -1
            continue
        tree[node, :2] = best[q, :2]
        tree[2 * node + 1, 2], tree[2 * node + 2, 2] = best[q, 3:]
    return bool((best[:, 0] >= 0).any())


def advanced(blocks: DataFrame, trees: dict[str, list[np.ndarray]], shape: Shape) -> tuple[DataFrame, str]:
    """The blocks with the trees' steps in their fitted values, stored, and their path."""
    known = blocks.sparkSession.sparkContext.broadcast({card: np.array(t) for card, t in trees.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = []
            for b in pdf.itertuples():
                keys, fitted = shape.read(b)
                f.append(shape.added(fitted, known.value[b.card_a], keys).tobytes())
            yield pdf.assign(f=f)

    return stored_at(blocks.mapInPandas(run, PACKED), "blocks", **PLAIN)


def splits(blocks: DataFrame, trees: dict[str, list[np.ndarray]], shape: Shape, level: int) -> dict[tuple[str, int], np.ndarray]:
    """``best_splits`` of a level by card and target; of the trees since the last writing the last one grows."""
    known = blocks.sparkSession.sparkContext.broadcast({card: np.array(t) for card, t in trees.items()})
    form = (3 if shape.binary else 2, 1 << level, int(shape.offsets[-1]))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for b in pdf.itertuples():
                keys, f = shape.read(b)
                here = known.value[b.card_a]
                total[b.card_a] = total.get(b.card_a, 0) + histograms(shape, keys, long(b.n), long(b.s).reshape(shape.targets, -1), shape.added(f, here[:-1], keys), here[-1], level)
        yield pd.DataFrame([(card, g, v[g].tobytes()) for card, v in total.items() for g in range(shape.targets)], columns=["card_a", "g", "sums"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        best = best_splits(shape, sum(np.frombuffer(b).reshape(form) for b in pdf["sums"]))
        return pd.DataFrame({"card_a": [pdf["card_a"].iloc[0]], "g": [int(pdf["g"].iloc[0])], "best": [best.tobytes()]})

    found = blocks.select("card_a", "keys", "n", "s", "f").mapInPandas(sums, "card_a string, g int, sums binary")
    many = min(-(-blocks.sparkSession.sparkContext.defaultParallelism // LANES), len(trees) * shape.targets)
    rows = found.repartition(many, "card_a", "g").groupBy("card_a", "g").applyInPandas(choose, "card_a string, g int, best binary").collect()
    return {(r["card_a"], r["g"]): np.frombuffer(bytes(r["best"])).reshape(-1, 5) for r in rows}


def boosted(rows: DataFrame, names: tuple[str, ...], targets: list[str], settings: dict, *, binary: bool = False, keep: bool = False) -> Boosting:
    """Boosted trees of every card and target; ``settings``: trees, rate, depth, leaf.

    ``rows`` is a stored table as ``packed`` takes it. ``keep`` keeps the trees on the driver, for scoring other rows:
    as many as cards times targets times trees. Cards without a row of weight are left out.
    """
    spark = rows.sparkSession
    edges, base, sizes = started(rows, names, targets, binary=binary)
    # Bins are numbered alike for all cards, as many a column as the card with most has.
    layout = Layout([max((len(e[i]) for e in edges.values()), default=0) + 1 for i in range(len(names))])
    out = Boosting(names, settings, binary, packed(rows, names, targets, {}, {}, {}, layout)[0] if not edges else None, edges, base, layout)
    if not edges:
        return out
    shape = Shape(layout, len(targets), settings, binary)

    def lane(cards: list[str]) -> DataFrame:
        of = lambda v: {card: v[card] for card in cards}
        blocks, path = packed(rows, names, targets, of(edges), of(base), of(sizes), layout)
        pending: dict[str, list[np.ndarray]] = {card: [] for card in cards}
        every: dict[str, list[np.ndarray]] = {card: [] for card in cards}
        for number in range(settings["trees"]):
            for card in pending:
                pending[card].append(shape.empty())
            for level in range(settings["depth"]):
                if not any([put(pending[card][-1][g], best, level) for (card, g), best in splits(blocks, pending, shape, level).items()]):
                    break
            if keep:
                for card in every:
                    every[card].append(pending[card][-1])
            if len(next(iter(pending.values()))) == KEPT or number == settings["trees"] - 1:
                before = path
                blocks, path = advanced(blocks, pending, shape)
                discard(spark, before)
                pending = {card: [] for card in cards}
        if keep:
            out.trees |= {card: np.array(t) for card, t in every.items()}
        return blocks

    # The largest cards are dealt first, so that lanes are alike.
    ranked = sorted(edges, key=lambda card: (-sizes[card], card))
    out.blocks = reduce(DataFrame.unionByName, beside(spark, *[partial(lane, ranked[i::LANES]) for i in range(min(LANES, len(ranked)))]))
    return out


def beside(spark: SparkSession, *runs: Callable[[], Any]) -> list:
    """What these return, run in threads."""
    with ThreadPoolExecutor(len(runs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run)) for run in runs]]


def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of ``SCORED`` rows or somewhat more: a batch has few rows of each card."""
    kept, n = [], 0
    for pdf in batches:
        kept.append(pdf)
        n += len(pdf)
        if n >= SCORED:
            yield pd.concat(kept, ignore_index=True)
            kept, n = [], 0
    if n:
        yield pd.concat(kept, ignore_index=True)


def fitted(known: tuple, names: list[str], settings: dict, pdf: pd.DataFrame) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each card its rows in a frame, and their fitted values (target, row) before any link."""
    edges, base, trees, layout = known
    for card, at in pdf.groupby("card_a").indices.items():
        keys = layout.keys(binned(pdf[names].take(at).to_numpy(dtype=float), edges[card]))
        yield card, at, advance(np.repeat(base[card][:, None], len(at), axis=1), trees[card], layout, keys, settings["rate"], settings["depth"])


def scorer(fit: Boosting, name: str) -> Callable[[DataFrame], DataFrame]:
    """A function that adds the fitted value of the one target to rows with card_a and the covariates; cards without a fit go.

    The trees of one target are broadcast: some 36 KB a card for 100 trees of depth 3, whatever the number of rows.
    """

    def score(rows: DataFrame) -> DataFrame:
        known = rows.sparkSession.sparkContext.broadcast((fit.edges, fit.base, fit.trees, fit.layout))
        names, settings, binary = list(fit.names), fit.settings, fit.binary

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in gathered(batches):
                value = np.empty(len(pdf))
                for _, at, f in fitted(known.value, names, settings, pdf):
                    value[at] = sigmoid(f[0]) if binary else f[0]
                yield pdf.assign(**{name: value})

        kept = rows.where(F.col("card_a").isin(*fit.edges)) if fit.edges else rows.limit(0)
        return kept.mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"`{name}` double"]))

    return score


def residuals(fit: Boosting, rows: DataFrame, targets: list[str]) -> DataFrame:
    """card_a, group_b, and over rows of card_a, the covariates, n, ``s_<target>`` and a weight w the sums of w n (``mass``) and of w times s less n times the fitted value (``rest``).

    The trees of all targets are broadcast, 36 KB a card and target for 100 trees of depth 3.
    """
    known = rows.sparkSession.sparkContext.broadcast((fit.edges, fit.base, fit.trees, fit.layout))
    names, settings = list(fit.names), fit.settings

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[str, np.ndarray] = {}
        for pdf in gathered(batches):
            n, w, s = (pdf[c].to_numpy(dtype=float) for c in ("n", "w", [f"s_{t}" for t in targets]))
            for card, at, f in fitted(known.value, names, settings, pdf):
                sums = out.setdefault(card, np.zeros(len(targets) + 1))
                sums += np.r_[w[at] @ n[at], (s[at].T - n[at] * f) @ w[at]]
        yield pd.DataFrame([(card, t, v[0], v[1 + i]) for card, v in out.items() for i, t in enumerate(targets)], columns=["card_a", "group_b", "mass", "rest"])

    kept = rows.where(F.col("card_a").isin(*fit.edges)) if fit.edges else rows.limit(0)
    parts = kept.select("card_a", *names, "n", "w", *[f"s_{t}" for t in targets]).mapInPandas(run, "card_a string, group_b string, mass double, rest double")
    return parts.groupBy("card_a", "group_b").agg(F.sum("mass").alias("mass"), F.sum("rest").alias("rest"))
