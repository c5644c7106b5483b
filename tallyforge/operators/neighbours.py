"""Exact nearest-neighbour joins of treated drafts and controls over weighted cells.

Points are distinct covariate cells, or distinct scores, with the number of controls in each. They are
dealt into boxes, the leaves of a tree of cuts through all coordinates, whose corners are small metadata. A treated
cell first meets the box that it would lie in, or boxes beside it if that holds fewer than ``k`` controls; the distance
of its ``k``-th control there bounds the search, and then it walks down the tree to every box whose nearest corner is
not farther. So no treated
cell meets a box that cannot matter, no control is left out, and the unit of work is a box, never
a card. Cuts are chosen from some points of each tree and only say where points are dealt: each point is in a box, and
corners are those of all points. Within a box distances are computed in blocks, and only the nearest points of each
treated cell leave it. Distances are rounded, so that equal covariates tie whatever the arithmetic, and tied controls
go by draft_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .cells import Cells, all_pairs, logistic, parameters, pool_of, propensity, spread

#: Points that a box holds about, so that there are more boxes for more points.
BOX_POINTS = 1_000
#: Points that cuts are chosen from, for each box.
SEEN = 8
#: Boxes of a card or pool at most; their corners are read by the driver.
MOST_BOXES = 4_096
#: Digits that squared distances, and scores, are rounded to.
DIGITS = 9
SCORE_DIGITS = 7
#: Boxes compared in one group: a group of its own for each would take longer to set up than to compare.
BUNDLE = 8
#: Distances in one block, and queries that walk down a tree together.
BLOCK = 1 << 18
WALK = 256


@dataclass
class Tree:
    """Cuts through points. A node of ``axis`` -1 is a box; of any other, points over ``cut`` on that axis go
    to the node after ``child``, all others to ``child``. Nodes come after their parents."""

    axis: np.ndarray
    cut: np.ndarray
    child: np.ndarray

    def box(self, x: np.ndarray) -> np.ndarray:
        """The box of each row."""
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while (inner := self.axis[node] >= 0).any():
            node = np.where(inner, self.child[node] + (x[rows, self.axis[node]] > self.cut[node]), node)
        return node

    def upward(self, values: np.ndarray, merge: Callable) -> np.ndarray:
        """``values`` of boxes by node, filled in for the nodes above."""
        for node in np.flatnonzero(self.axis >= 0)[::-1]:
            values[node] = merge(values[self.child[node]], values[self.child[node] + 1])
        return values


#: All in one box.
WHOLE = Tree(np.array([-1]), np.zeros(1), np.zeros(1, dtype=np.int64))


@dataclass
class Space:
    """Points in boxes, and what a card needs to search them.

    ``points``: the key (a pool or a card), box, point (a number), coordinates, n. ``gone``: card_a,
    key, box, lists of points and of how many of their drafts are no controls of the card (``less``). ``scale``: by card
    the means and inverse deviations of the coordinates. ``controls``: by card the controls in each box.
    ``trees``: by key. ``keys``: the key of each card.
    """

    key: str
    names: tuple[str, ...]
    points: DataFrame
    gone: DataFrame | None
    scale: dict[str, tuple[np.ndarray, np.ndarray]]
    controls: dict[str, dict[int, int]]
    trees: dict[str, Tree]
    keys: dict[str, str]


def grown(x: np.ndarray, boxes: int) -> Tree:
    """The box of most rows is cut at the median of its widest axis, until there are ``boxes`` or all rows of each are equal."""
    sd = x.std(axis=0)
    z = x / np.where(sd > 0, sd, 1.0)
    axis, cut, child = [-1], [0.0], [0]
    open_, left = [(-len(x), 0, np.arange(len(x)))], boxes - 1
    while open_ and left > 0:
        _, node, at = heappop(open_)
        if len(at) < 2 or not (width := np.ptp(z[at], axis=0)).any():
            continue
        wide = int(np.where(width > 0, z[at].std(axis=0), -1.0).argmax())
        values = np.sort(x[at, wide])
        middle = values[(len(values) - 1) // 2]
        # Something has to lie above the cut.
        edge = middle if middle < values[-1] else values[values < middle][-1]
        axis[node], cut[node], child[node] = wide, edge, len(axis)
        for side in (x[at, wide] <= edge, x[at, wide] > edge):
            heappush(open_, (-int(side.sum()), len(axis), at[side]))
            axis.append(-1), cut.append(0.0), child.append(0)
        left -= 1
    return Tree(np.array(axis), np.array(cut), np.array(child))


def planted(points: DataFrame, key: str, names: tuple[str, ...]) -> dict[str, Tree]:
    """A tree for each key with points for more than a box; some points of each, chosen by hash, are looked at for the cuts."""
    plan = {}
    for r in points.groupBy(key).agg(F.count("*").alias("n")).collect():
        boxes = min(MOST_BOXES, round(r["n"] / BOX_POINTS))
        if boxes > 1:
            plan[r[key]] = (boxes, max(1, r["n"] // (SEEN * boxes)))
    if not plan:
        return {}
    spark = points.sparkSession
    one_in = F.broadcast(spark.createDataFrame([(k, every) for k, (_, every) in plan.items()], f"{key} string, _every long"))
    seen = points.join(one_in, key).where(F.pmod(F.xxhash64(*names), F.col("_every")) == 0).select(key, *[F.col(c).cast("double").alias(c) for c in names])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # In order of value, so that cuts do not depend on partitions.
        pdf = pdf.sort_values(list(names))
        tree = grown(pdf[list(names)].to_numpy(dtype=float), plan[pdf[key].iloc[0]][0])
        return pd.DataFrame({key: pdf[key].iloc[0], "axis": [tree.axis], "cut": [tree.cut], "child": [tree.child]})

    rows = seen.groupBy(key).applyInPandas(run, f"{key} string, axis array<int>, cut array<double>, child array<long>").collect()
    return {r[key]: Tree(np.array(r["axis"]), np.array(r["cut"]), np.array(r["child"])) for r in rows}


def boxed(points: DataFrame, key: str, names: tuple[str, ...], trees: dict[str, Tree]) -> DataFrame:
    """Adds ``box``, the leaf of its key's tree (a card's or a pool's) that a point lies in."""
    if not trees:
        return points.withColumn("box", F.lit(0))
    ends = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)]
    columns = [f"_x{i}" for i in range(len(names))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            box, x = np.zeros(len(pdf), dtype=np.int32), pdf[columns].to_numpy(dtype=float)
            for k, at in pdf.groupby(key).indices.items():
                box[at] = trees.get(k, WHOLE).box(x[at])
            yield pdf.drop(columns=columns).assign(box=box)

    return points.select("*", *ends).mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema) + ", box int")


def corners(space: Space) -> dict[str, tuple[Tree, np.ndarray, np.ndarray]]:
    """The tree of each key with the least and greatest values of the coordinates by node: a tree's worth of rows a key."""
    found: dict[str, tuple[Tree, np.ndarray, np.ndarray]] = {}
    ends = [f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(space.names) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    for r in space.points.groupBy(space.key, "box").agg(*ends).collect():
        if r[space.key] not in found:
            tree = space.trees.get(r[space.key], WHOLE)
            found[r[space.key]] = (tree, np.full((len(tree.axis), len(space.names)), np.inf), np.full((len(tree.axis), len(space.names)), -np.inf))
        _, low, high = found[r[space.key]]
        low[r["box"]], high[r["box"]] = [r[f"lo{i}"] for i in range(len(space.names))], [r[f"hi{i}"] for i in range(len(space.names))]
    return {k: (tree, tree.upward(low, np.minimum), tree.upward(high, np.maximum)) for k, (tree, low, high) in found.items()}


def by_card(pdf: pd.DataFrame, key: str) -> Iterator[tuple[str, str, np.ndarray]]:
    """The rows of each card, with its key, some at a time; a card has one."""
    for card, at in pdf.groupby("card_a").indices.items():
        for a in range(0, len(at), WALK):
            yield card, pdf[key].iloc[at[0]], at[a : a + WALK]


def enough(tree: Tree, held: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The lowest node on each row's way down that holds ``k`` controls; it leaves its own side where only the other does. Under that node fewer than 2 ``k`` boxes hold any, unless it is a box."""
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while True:
        own = (x[rows, tree.axis[node]] > tree.cut[node]).astype(np.int64)
        side = np.where(held[tree.child[node] + own] >= k, own, 1 - own)
        down = (tree.axis[node] >= 0) & (held[tree.child[node] + side] >= k)
        if not down.any():
            return node
        node = np.where(down, tree.child[node] + side, node)


def nearest_boxes(space: Space, queries: DataFrame, k: int) -> DataFrame:
    """``queries`` once for each box that they have to meet: one beside them with ``k`` controls, or with ``bound``, all that do not lie beyond it."""
    edges, names, key, schema, scale = corners(space), list(space.names), space.key, queries.schema, space.scale
    bounded = "bound" in queries.columns
    held = {}
    for card, pool in space.keys.items():
        if pool not in edges:
            continue
        tree, by_box = edges[pool][0], space.controls.get(card, {})
        held[card] = np.zeros(len(tree.axis) + 1, dtype=np.int64)
        held[card][list(by_box)] = list(by_box.values())
        held[card] = tree.upward(held[card], np.add)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for card, pool, at in by_card(pdf, key):
                if card not in held:
                    continue
                (tree, low, high), x, n = edges[pool], pdf[names].to_numpy(dtype=float)[at], held[card]
                row, node = np.arange(len(at)), np.zeros(len(at), dtype=np.int64) if bounded else enough(tree, n, x, k)
                # The slack covers the rounding of distances and of these corners.
                most = pdf["bound"].to_numpy()[at] * (1 + 1e-9) + 10.0**-DIGITS if bounded else np.full(len(at), np.inf)
                met = []
                while len(row):
                    row, node = row[n[node] > 0], node[n[node] > 0]
                    gap = np.maximum(np.maximum(low[node] - x[row], x[row] - high[node]), 0) * scale[card][1]
                    near = (gap * gap).sum(axis=1) <= most[row]
                    row, node = row[near], node[near]
                    inner = tree.axis[node] >= 0
                    met.append((row[~inner], node[~inner]))
                    row, node = np.tile(row[inner], 2), np.concatenate([tree.child[node[inner]], tree.child[node[inner]] + 1])
                row, box = (np.concatenate(v) for v in zip(*met, strict=True))
                yield pdf.iloc[at[row]].assign(box=box.astype(np.int32))

    return queries.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", box int")


def nearest_points(space: Space, met: DataFrame, k: int) -> DataFrame:
    """card_a, q, point, d, n: of each box the points that are among the ``k`` nearest of a query that meets it, ties all.

    Some boxes are a group: points on one side, on the other the queries, and the drafts in each
    box that are no controls of a card, one row a card and box.
    """
    names, key, scale = list(space.names), space.key, space.scale
    coordinates = [F.col(c).cast("double").alias(c) for c in names]
    bound = F.col("bound") if "bound" in met.columns else F.lit(None).cast("double")
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("points", "less")]
    asked = met.select(key, "box", "card_a", "q", bound.alias("bound"), *coordinates, *none)
    if space.gone is not None:
        none = [F.lit(None).cast("double").alias(c) for c in ("bound", *names)]
        asked = asked.unionByName(space.gone.select(key, "box", "card_a", F.lit(None).cast("long").alias("q"), *none, "points", "less"))
    # Small in bytes, long to compare: a fixed number of partitions keeps AQE from merging the boxes into one task.
    spark = met.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys, bundle = [key, "bundle"], F.expr(f"box div {BUNDLE}").alias("bundle")
    points = space.points.select(key, bundle, "box", "point", *coordinates, "n").repartition(parts, *keys)
    asked = asked.select(*dict.fromkeys([key, *asked.columns]), bundle).repartition(parts, *keys)

    def run(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        points = points.sort_values(["box", "point"])
        boxes, names_, x, n = points["box"].to_numpy(), points["point"].to_numpy(), points[names].to_numpy(dtype=float), points["n"].to_numpy()
        none, queries = asked[asked["q"].isna()], asked[asked["q"].notna()]
        gone = {(box, card): (p, less) for box, card, p, less in zip(none["box"], none["card_a"], none["points"], none["less"], strict=True)}
        q, wants, bounds = queries["q"].to_numpy(dtype=np.int64), queries[names].to_numpy(dtype=float), queries["bound"].fillna(np.inf).to_numpy(dtype=float)
        for (box, card), ask in queries.groupby(["box", "card_a"]).indices.items():
            a, b = np.searchsorted(boxes, [box, box + 1])
            net = n[a:b].copy()
            if (box, card) in gone:
                p, less = gone[box, card]
                np.subtract.at(net, np.searchsorted(names_[a:b], p), less)
            ok = np.flatnonzero(net > 0)
            if not len(ok):
                continue
            mean, inverse = scale[card]
            pool, wanted, most, point, net = (x[a:b][ok] - mean) * inverse, (wants[ask] - mean) * inverse, bounds[ask], names_[a:b][ok], net[ok]
            size = max(1, BLOCK // len(pool))
            for a in range(0, len(ask), size):
                d = np.zeros((len(wanted[a : a + size]), len(pool)))
                for w, p in zip(wanted[a : a + size].T, pool.T, strict=True):
                    gap = w[:, None] - p[None]
                    d += gap * gap
                last = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
                last = np.minimum(last.round(DIGITS), most[a : a + size])
                # Only what may round to the last or less is rounded.
                row, at_point = np.nonzero(d <= (last * (1 + 1e-9) + 10.0**-DIGITS)[:, None])
                near = d[row, at_point].round(DIGITS)
                kept = near <= last[row]
                row, at_point = row[kept], at_point[kept]
                out.append((np.full(len(row), card, dtype=object), q[ask[a + row]], point[at_point], near[kept], net[at_point]))
        columns = [np.concatenate(v) for v in zip(*out, strict=True)] if out else [np.array([], dtype=t) for t in (object, "int64", "int64", "float64", "int64")]
        return pd.DataFrame(dict(zip(("card_a", "q", "point", "d", "n"), columns, strict=True)))

    return points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "card_a string, q long, point long, d double, n long")


def taken(met: DataFrame, k: int) -> DataFrame:
    """Of (card_a, q, point, d, n) the points that hold the ``k`` nearest controls of each query, ties of the last all."""
    by = Window.partitionBy("card_a", "q").orderBy("d")
    near = met.withColumn("_r", F.rank().over(by)).where(F.col("_r") <= k).drop("_r")
    held = near.groupBy("card_a", "q", "d").agg(F.sum("n").alias("_n"))
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_before") < k)
    return near.join(held, ["card_a", "q", "d"]).drop("_n", "_before")


def search(space: Space, queries: DataFrame, k: int) -> DataFrame:
    """card_a, q, point, d, n: the points that hold the ``k`` nearest controls of each query (card_a, key, q, coordinates), stored."""
    first = taken(nearest_points(space, nearest_boxes(space, queries, k), k), k)
    bound = stored(first.groupBy("card_a", "q").agg(F.max("d").alias("bound")), "bound")
    second = nearest_boxes(space, queries.join(bound, ["card_a", "q"]), k)
    return stored(taken(nearest_points(space, second, k), k), "chosen")


def queries_of(cells: Cells) -> DataFrame:
    """Treated cells of all cards, numbered, stored."""
    kept = cells.own.where("n_t > 0").select("card_a", "pool", *cells.names, "n_t", *[f"t_{g}" for g in cells.groups])
    return stored(kept.withColumn("q", F.monotonically_increasing_id()), "treated")


def compared(cells: Cells, queries: DataFrame, chosen: DataFrame, wanted: DataFrame, k: int, method: str) -> DataFrame:
    """Effects from the chosen points: the ``k`` first controls of each query by distance and draft_id.

    ``wanted``: card_a, point, pool and covariates of the cells behind the chosen points.
    """
    groups, names = cells.groups, cells.names
    members = wanted.join(cells.drafts(), ["pool", *names]).join(cells.gone, ["card_a", "draft_id"], "left_anti")
    # Of equal controls only the first k can be among the nearest.
    members = members.withColumn("_r", F.row_number().over(Window.partitionBy("card_a", "point").orderBy("draft_id"))).where(F.col("_r") <= k)
    near = chosen.select("card_a", "q", "point", "d").join(members.drop("_r"), ["card_a", "point"])
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("card_a", "q").orderBy("d", "draft_id"))).where(F.col("_r") <= k)
    means = near.groupBy("card_a", "q").agg(*[F.avg(f"Y_{g}").alias(f"m_{g}") for g in groups])
    gap = queries.join(means, ["card_a", "q"]).groupBy("card_a").agg(F.sum("n_t").alias("_n"), *[F.sum(F.col(f"t_{g}") - F.col("n_t") * F.col(f"m_{g}")).alias(f"v_{g}") for g in groups])
    values = F.explode(F.array(*[F.struct(F.lit(g).alias("group_b"), (F.col(f"v_{g}") / F.col("_n")).alias("value")) for g in groups]))
    found = gap.select("card_a", values.alias("v")).select("card_a", "v.*")
    return all_pairs(cells, method).join(found, ["card_a", "group_b"], "left").select("method", "card_a", "group_b", "value")


def counts_in(rows: DataFrame) -> dict[str, dict[int, int]]:
    """n by card and box: metadata."""
    out: dict[str, dict[int, int]] = {}
    for r in rows.select("card_a", "box", "n").collect():
        out.setdefault(r["card_a"], {})[r["box"]] = r["n"]
    return out


def match_covariates(cells: Cells, k: int = 3) -> DataFrame:
    """Each treated draft against its ``k`` nearest controls in the covariates, scaled over the card's drafts."""
    names = cells.names
    trees = planted(cells.pool, "pool", names)
    points = stored(boxed(cells.pool.select("pool", *names, "n"), "pool", names, trees).withColumn("point", F.monotonically_increasing_id()), "points")
    less = cells.own.where("n_t + n_h > 0").select("card_a", "pool", *names, (F.col("n_t") + F.col("n_h")).alias("gone"))
    less = less.join(points.drop("n"), ["pool", *names]).groupBy("card_a", "pool", "box").agg(F.sum("gone").alias("gone"), F.collect_list(F.struct("point", "gone")).alias("_of"))
    gone = stored(less.select("card_a", "pool", "box", "gone", F.col("_of.point").alias("points"), F.col("_of.gone").alias("less")), "gone")
    own = gone.select("card_a", "box", "gone")
    net = cells.cards.join(points.groupBy("pool", "box").agg(F.sum("n").alias("n")), "pool").join(own, ["card_a", "box"], "left")
    inverse = lambda sd: np.where(sd > 0, 1 / np.where(sd > 0, sd, 1.0), 0.0)
    scale = {c: (np.array(v["mean"]), inverse(np.array(v["sd"]))) for c, v in spread(cells).items()}
    space = Space("pool", names, points, gone, scale, counts_in(net.select("card_a", "box", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n"))), trees, dict(pool_of(cells)))
    queries = queries_of(cells)
    chosen = search(space, queries.select("card_a", "pool", "q", *[F.col(c).cast("double").alias(c) for c in names]), k)
    wanted = chosen.select("card_a", "point").distinct().join(points.drop("n", "box"), "point")
    return compared(cells, queries, chosen, wanted, k, "match_cov_k3")


def match_scores(cells: Cells, k: int = 3, c: float = 0.35) -> DataFrame:
    """Each treated draft against its ``k`` nearest controls by logistic propensity."""
    method = "match_ps_logit_k3"
    of = logistic(cells, c)
    if not of:
        return all_pairs(cells, method).withColumn("value", F.lit(None).cast("double"))
    return match_given(cells, of, k, method)


def match_given(cells: Cells, of: dict[str, dict[str, list[float]]], k: int, method: str) -> DataFrame:
    """The same by fitted parameters; scores are compared to ``SCORE_DIGITS``."""
    whole = F.round(propensity(cells.names) * F.lit(10.0**SCORE_DIGITS)).cast("long")
    known = parameters(cells, of).drop("pool")
    return match_scored(cells, lambda rows: rows.join(known, "card_a").select(*rows.columns, whole.alias("e")), list(of), k, method)


def match_scored(cells: Cells, scored: Callable[[DataFrame], DataFrame], cards: list[str], k: int, method: str) -> DataFrame:
    """The same by any score: ``scored`` adds ``e``, a whole number, to rows with card_a and the covariates of ``cards``."""
    if not cards:
        return all_pairs(cells, method).withColumn("value", F.lit(None).cast("double"))
    names, fitted = cells.names, F.col("card_a").isin(*cards)
    pool = F.broadcast(cells.cards.where(fitted)).join(cells.pool, "pool").select("card_a", "pool", *names, "n")
    own = cells.own.where(fitted & (F.col("n_t") + F.col("n_h") > 0)).select("card_a", *names, (-F.col("n_t") - F.col("n_h")).alias("n"))
    points = scored(pool).select("card_a", "e", "n").unionByName(scored(own).select("card_a", "e", "n")).groupBy("card_a", "e").agg(F.sum("n").alias("n")).where("n > 0")
    # A score is the name of its point, and the only coordinate.
    points = stored(points, "scores")
    trees = planted(points, "card_a", ("e",))
    points = stored(boxed(points, "card_a", ("e",), trees).withColumn("point", F.col("e")), "points")
    controls = counts_in(points.groupBy("card_a", "box").agg(F.sum("n").alias("n")))
    space = Space("card_a", ("e",), points, None, {card: (np.zeros(1), np.ones(1)) for card in cards}, controls, trees, {card: card for card in cards})
    treated = queries_of(cells)
    queries = stored(scored(treated.where(fitted)).select("card_a", "q", F.col("e").cast("double").alias("e")), "queries")
    chosen = search(space, queries, k)
    # From the chosen scores back to the cells that have them.
    wanted = scored(pool.drop("n")).withColumnRenamed("e", "point").join(chosen.select("card_a", "point").distinct(), ["card_a", "point"])
    return compared(cells, treated.join(queries.select("card_a", "q"), ["card_a", "q"], "left_semi"), chosen, wanted, k, method)
