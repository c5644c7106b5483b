"""Small learners in numpy for grouped Arrow functions: logistic, boosted trees, forest, net."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import prod

import numpy as np


#: Bins of a column at most.
BINS = 65
#: Joint bins of several columns at most.
JOINT = 4096
#: Rows that a net scores at once.
SCORED = 8192


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def chosen_split(gain: np.ndarray) -> int:
    """The first of the best gains, equal but for rounding, so that sums in another order choose alike; -1 if none is above 0."""
    best = gain.max(initial=-1.0)
    return int(np.argmax(gain.ravel() >= best * (1 - 1e-9))) if best > 1e-12 else -1


class Coded:
    """A matrix kept as codes into each column's distinct values, taken in batches of rows: a byte a number where a column has few."""

    def __init__(self, width: int):
        self.levels, self.codes, self.parts = [np.empty(0)] * width, [np.empty(0, dtype=np.uint8)] * width, [[] for _ in range(width)]

    def add(self, rows: np.ndarray) -> None:
        for column, parts in zip(rows.T, self.parts, strict=True):
            levels, codes = np.unique(column, return_inverse=True)
            parts.append((levels, codes.astype(np.min_scalar_type(max(1, len(levels))))))

    def done(self, order: np.ndarray | None = None) -> Coded:
        """All batches under one list of values a column, in this order of rows."""
        for j, parts in enumerate(self.parts):
            if parts:
                self.levels[j] = np.unique(np.concatenate([levels for levels, _ in parts]))
                kind = np.min_scalar_type(max(1, len(self.levels[j])))
                codes = np.concatenate([np.searchsorted(self.levels[j], levels).astype(kind)[codes] for levels, codes in parts])
                self.codes[j] = codes if order is None else codes[order]
                parts.clear()
        return self

    def __len__(self) -> int:
        return len(self.codes[0])

    def column(self, j: int) -> np.ndarray:
        return self.levels[j][self.codes[j]]

    def __getitem__(self, rows) -> np.ndarray:
        return np.array([levels[codes[rows]] for levels, codes in zip(self.levels, self.codes, strict=True)]).T

    def take(self, rows: np.ndarray) -> Coded:
        """Some rows, coded still."""
        out = Coded(len(self.levels))
        out.levels, out.codes = self.levels, [codes[rows] for codes in self.codes]
        return out

    def select(self, columns: list[int]) -> Coded:
        """Some columns; codes are shared."""
        out = Coded(len(columns))
        out.levels, out.codes = [self.levels[j] for j in columns], [self.codes[j] for j in columns]
        return out

    def quantiles(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """Quantiles of each column, by straight lines between neighbours, from how often each value is there."""
        for levels, codes in zip(self.levels, self.codes, strict=True):
            ends = np.cumsum(np.bincount(codes, minlength=len(levels)))
            place = at * (len(codes) - 1)
            low = np.floor(place)
            a, b = (levels[np.searchsorted(ends, np.minimum(i, len(codes) - 1), side="right")] for i in (low, low + 1))
            share = place - low
            yield np.where(share >= 0.5, b - (b - a) * (1 - share), a + (b - a) * share)

    def scaled(self) -> tuple[Coded, np.ndarray, np.ndarray]:
        """Columns to mean 0 and deviation 1 (constant ones to 0), and what was taken off and divided by; codes are shared."""
        out, moments = Coded(len(self.levels)), [((c := self.column(j)).mean(), c.std()) for j in range(len(self.levels))]
        mean, sd = (np.array(m) for m in zip(*moments, strict=True))
        sd = np.where(sd > 1e-12, sd, 1.0)
        out.codes, out.levels = self.codes, [(v - m) / d for v, m, d in zip(self.levels, mean, sd, strict=True)]
        return out, mean, sd


def coded(x: np.ndarray | Coded) -> Coded:
    if isinstance(x, Coded):
        return x
    out = Coded(x.shape[1])
    out.add(x)
    return out.done()


class Logit:
    """L2 logistic regression on scaled columns; ``c`` is the inverse strength."""

    def __init__(self, c: float = 0.35, steps: int = 100):
        self.c, self.steps = c, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logit:
        self.mean, sd = x.mean(axis=0), x.std(axis=0)
        self.sd = np.where(sd > 1e-12, sd, 1.0)
        z = np.column_stack([(x - self.mean) / self.sd, np.ones(len(x))])
        ridge = np.diag([1.0] * x.shape[1] + [1e-9])
        w = np.zeros(z.shape[1])
        for _ in range(self.steps):
            p = sigmoid(z @ w)
            h = self.c * (z * (p * (1 - p))[:, None]).T @ z + ridge
            step = np.linalg.solve(h, self.c * z.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-10:
                break
        self.w = w
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.column_stack([(x - self.mean) / self.sd, np.ones(len(x))]) @ self.w)


class Layout:
    """Bins of several columns in one number, as many columns as have ``JOINT`` joint bins at most.

    Sums by joint bin take one pass for all these columns and add up to each column's. Columns' bins stand one after
    another in the sums, from ``offsets``.
    """

    def __init__(self, sizes: list[int]):
        self.sizes, self.offsets = list(map(int, sizes)), np.cumsum([0, *sizes])
        self.parts: list[list[int]] = []
        for j in sorted(range(len(self.sizes)), key=lambda j: -self.sizes[j]):
            room = (p for p in self.parts if prod(self.sizes[i] for i in p) * self.sizes[j] <= JOINT)
            if (part := next(room, None)) is None:
                self.parts.append([j])
            else:
                part.append(j)
        self.of = {j: (p, i) for p, part in enumerate(self.parts) for i, j in enumerate(part)}

    def keys(self, bins: np.ndarray) -> np.ndarray:
        """(part, row) numbers of rows of bins."""
        out = np.empty((len(self.parts), len(bins)), dtype=np.uint16)
        for key, (first, *more) in zip(out, self.parts, strict=True):
            key[:] = bins[:, first]
            for j in more:
                key *= np.uint16(self.sizes[j])
                key += bins[:, j]
        return out

    def above(self, j: int, cut: int) -> tuple[int, np.ndarray]:
        """The part of a column, and for its joint bins whether the column's bin is above the cut."""
        p, i = self.of[j]
        shape = [self.sizes[k] for k in self.parts[p]]
        out = np.zeros(shape, dtype=bool)
        out[(slice(None),) * i + (slice(cut + 1, None),)] = True
        return p, out.ravel()

    def sums(self, keys: list[np.ndarray], kinds: list[np.ndarray | None], node: np.ndarray | None = None, nodes: int = 1) -> np.ndarray:
        """(kind, node, bin) sums of the kinds (of 1 for None) over rows given by their keys, and their nodes."""
        out = np.empty((len(kinds), nodes, int(self.offsets[-1])))
        # One room for all parts: memory that is new costs more than the sums.
        slots = np.empty(len(keys[0]) if len(keys) else 0, dtype=np.intp)
        for key, part in zip(keys, self.parts, strict=True):
            shape = [self.sizes[j] for j in part]
            many = prod(shape)
            if node is None:
                slots[:] = key
            else:
                np.multiply(node, many, out=slots, dtype=np.intp)
                slots += key
            for v, to in zip(kinds, out, strict=True):
                h = np.bincount(slots, weights=v, minlength=nodes * many).reshape(nodes, *shape)
                for i, j in enumerate(part):
                    to[:, self.offsets[j] : self.offsets[j + 1]] = h.sum(axis=tuple(k + 1 for k in range(len(part)) if k != i))
        return out


class Binner:
    """Columns to quantile bins."""

    def __init__(self, x: np.ndarray | Coded):
        at = np.linspace(0, 1, BINS)[1:-1]
        self.edges = [np.unique(q) for q in (x.quantiles(at) if isinstance(x, Coded) else (np.quantile(c, at) for c in x.T))]
        self.layout = Layout([len(e) + 1 for e in self.edges])

    def __call__(self, x: np.ndarray | Coded) -> np.ndarray:
        out = np.empty((len(x), len(self.edges)), dtype=np.uint8, order="F")
        for j, e in enumerate(self.edges):
            # A value's bin is looked up once where values are kept as codes.
            out[:, j] = np.searchsorted(e, x.levels[j], side="left").astype(np.uint8)[x.codes[j]] if isinstance(x, Coded) else np.searchsorted(e, x[:, j], side="left")
        return out


class Binned:
    """Rows by a binner, one of their own if none is given: their bins and joint keys."""

    def __init__(self, x: np.ndarray | Coded, binner: Binner | None = None):
        self.binner = binner or Binner(x)
        self.layout, self.bins = self.binner.layout, self.binner(x)
        self.keys = self.layout.keys(self.bins)

    def __len__(self) -> int:
        return len(self.bins)

    def sums(self, at: np.ndarray, kinds: list[np.ndarray | None]) -> np.ndarray:
        """(kind, bin) sums over some rows."""
        kinds = [None if v is None else v[at] for v in kinds]
        if len(at) > 2 * JOINT:
            return self.layout.sums([key.take(at) for key in self.keys], kinds)[:, 0]
        # Joint bins are too many for few rows.
        slots = (self.bins[at] + self.layout.offsets[:-1]).ravel()
        width = self.bins.shape[1]
        return np.array([np.bincount(slots, weights=None if v is None else np.repeat(v, width), minlength=int(self.layout.offsets[-1])) for v in kinds], dtype=float)


def binned(x: np.ndarray | Coded | Binned, binner: Binner | None = None) -> Binned:
    return x if isinstance(x, Binned) else Binned(x, binner)


class Tree:
    """A regression tree over binned columns, grown level by level for weighted targets."""

    def __init__(self, depth: int, leaf: int, columns: float = 1.0):
        self.depth, self.leaf, self.columns = depth, leaf, columns

    def fit(self, rows: Binned, target: np.ndarray, weight: np.ndarray | None = None, rng: np.random.Generator | None = None, at: np.ndarray | None = None, times: np.ndarray | None = None) -> Tree:
        """On the rows ``at`` (all if None); ``times`` is how often each row is taken. ``leaves`` then has each leaf's rows."""
        self.nodes: list[tuple] = []
        self.leaves: list[tuple[int, np.ndarray]] = []
        w = times if weight is None else weight if times is None else weight * times
        # Without weights, a bin's weight is its number of rows.
        kinds = [times, *([] if weight is None else [w]), target if w is None else w * target]
        self._grow(rows, kinds, np.arange(len(rows)) if at is None else at, 0, None, rng)
        return self

    def _grow(self, rows: Binned, kinds: list, at: np.ndarray, depth: int, sums: np.ndarray | None, rng) -> int:
        me, offsets = len(self.nodes), rows.layout.offsets
        number, mass, total = (len(at) if v is None else v[at].sum() for v in (kinds[0], kinds[-2], kinds[-1]))
        self.nodes.append((-1, 0, total / mass if mass > 0 else 0.0, 0, 0))
        if depth == self.depth or number < 2 * self.leaf or mass <= 0:
            self.leaves.append((me, at))
            return me
        sums = rows.sums(at, kinds) if sums is None else sums
        # Running sums within each column; the last bin of a column is no cut.
        ends = np.cumsum(sums, axis=1)
        before = np.concatenate([np.zeros((len(sums), 1)), ends[:, offsets[1:-1] - 1]], axis=1)
        left = ends - np.repeat(before, rows.layout.sizes, axis=1)
        n, lw, ls = left[0], left[-2], left[-1]
        ok = (n >= self.leaf) & (number - n >= self.leaf) & (lw > 0) & (mass - lw > 0)
        ok[offsets[1:] - 1] = False
        if self.columns < 1 and rng is not None:
            width = len(rows.layout.sizes)
            kept = np.ones(width, dtype=bool)
            kept[rng.permutation(width)[max(1, int(self.columns * width)) :]] = False
            ok &= np.repeat(kept, rows.layout.sizes)
        gain = np.where(ok, ls**2 / np.where(ok, lw, 1) + (total - ls) ** 2 / np.where(ok, mass - lw, 1) - total**2 / mass, -1.0)
        best = chosen_split(gain)
        if best < 0:
            self.leaves.append((me, at))
            return me
        j = int(np.searchsorted(offsets, best, side="right")) - 1
        cut = best - int(offsets[j])
        part, above = rows.layout.above(j, cut)
        high = above[rows.keys[part].take(at)]
        sides, parts = [at[~high], at[high]], [None, None]
        if depth + 1 < self.depth:
            # The smaller side is counted; the other's sums are what is left.
            small = int(len(sides[1]) < len(sides[0]))
            parts[small] = rows.sums(sides[small], kinds)
            parts[1 - small] = sums - parts[small]
        del at, high, sums
        a = self._grow(rows, kinds, sides[0], depth + 1, parts[0], rng)
        b = self._grow(rows, kinds, sides[1], depth + 1, parts[1], rng)
        self.nodes[me] = (j, cut, self.nodes[me][2], a, b)
        return me

    def apply(self, rows: Binned, at: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row, or of the rows ``at``."""
        at = np.arange(len(rows)) if at is None else at
        out = np.zeros(len(at), dtype=np.int16)
        todo = [(0, np.arange(len(at)), at)]
        while todo:
            node, to, some = todo.pop()
            j, cut, _, a, b = self.nodes[node]
            if j < 0 or not len(some):
                out[to] = node
                continue
            part, above = rows.layout.above(j, cut)
            high = above[rows.keys[part].take(some)]
            todo += [(a, to[~high], some[~high]), (b, to[high], some[high])]
        return out

    @property
    def values(self) -> np.ndarray:
        return np.array([n[2] for n in self.nodes])

    def predict(self, rows: Binned, at: np.ndarray | None = None) -> np.ndarray:
        return self.values[self.apply(rows, at)]


class Boosted:
    """Gradient boosting; logistic loss with Newton leaves if ``binary``."""

    def __init__(self, trees: int, rate: float, depth: int, leaf: int, *, binary: bool):
        self.args, self.rate, self.n, self.binary = (depth, leaf), rate, trees, binary

    def fit(self, x: np.ndarray | Coded | Binned, y: np.ndarray) -> Boosted:
        rows = binned(x)
        self.binner = rows.binner
        mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if self.binary else float(y.mean())
        self.base = float(np.log(mean / (1 - mean))) if self.binary else mean
        f, self.trees = np.full(len(y), self.base), []
        for _ in range(self.n):
            if self.binary:
                p = sigmoid(f)
                w = np.maximum(p * (1 - p), 1e-6)
                tree = Tree(*self.args).fit(rows, (y - p) / w, w)
            else:
                tree = Tree(*self.args).fit(rows, y - f)
            for node, at in tree.leaves:
                f[at] += self.rate * tree.nodes[node][2]
            tree.leaves.clear()
            self.trees.append(tree)
        return self

    def predict(self, x: np.ndarray | Coded | Binned) -> np.ndarray:
        return self.staged(x, [self.n])[0]

    def staged(self, x: np.ndarray | Coded | Binned, counts: list[int]) -> list[np.ndarray]:
        """What the first trees alone predict, for each of these numbers of trees."""
        rows, f, out = binned(x, self.binner), np.zeros(len(x)), {}
        for i in range(max(counts) + 1):
            if i in counts:
                out[i] = sigmoid(self.base + self.rate * f) if self.binary else self.base + self.rate * f
            if i < max(counts):
                f += self.trees[i].predict(rows)
        return [out[i] for i in counts]


class Forest:
    """Bagged trees with column sampling; honest if asked: structure and leaf values from two halves."""

    def __init__(self, trees: int = 60, depth: int = 8, leaf: int = 20, *, honest: bool = False, seed: int = 42):
        self.n, self.args, self.honest, self.seed = trees, (depth, leaf, 0.6), honest, seed

    def fit(self, x: np.ndarray | Coded | Binned, y: np.ndarray, weight: np.ndarray | None = None) -> Forest:
        rng = np.random.default_rng(self.seed)
        rows = binned(x)
        self.binner, self.trees = rows.binner, []
        for _ in range(self.n):
            if not self.honest:
                # A row drawn several times is kept once, with its number.
                times = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
                tree = Tree(*self.args).fit(rows, y, weight, rng, np.flatnonzero(times), times)
            else:
                take = rng.permutation(len(y))[: max(2, len(y) // 2 * 2 * 9 // 10)]
                # In the rows' order, which is faster to read.
                first, second = np.sort(take[::2]), np.sort(take[1::2])
                tree = Tree(*self.args).fit(rows, y, weight, rng, first)
                leaf = tree.apply(rows, second)
                w = np.ones(len(second)) if weight is None else weight[second]
                mass = np.bincount(leaf, weights=w, minlength=len(tree.nodes))
                total = np.bincount(leaf, weights=w * y[second], minlength=len(tree.nodes))
                tree.nodes = [(j, c, total[i] / mass[i] if mass[i] > 0 else v, a, b) for i, (j, c, v, a, b) in enumerate(tree.nodes)]
            tree.leaves.clear()
            self.trees.append(tree)
        return self

    def predict(self, x: np.ndarray | Coded | Binned) -> np.ndarray:
        rows, out = binned(x, self.binner), np.zeros(len(x))
        for t in self.trees:
            out += t.predict(rows)
        return out / len(self.trees)

    def importances(self, width: int) -> np.ndarray:
        """Share of splits by column."""
        n = np.bincount([j for t in self.trees for j, *_ in t.nodes if j >= 0], minlength=width)
        return n / max(1, n.sum())


class ThreeHeads:
    """Two shared layers, a treatment head and two outcome heads, several outcomes at once.

    Trained by Adam with clipped gradients on the squared losses of the observed arms plus the log
    loss of the treatment. The rate halves when the validation loss (rows kept in the arms'
    proportions) has not fallen for ``plateau`` epochs; training stops after ``patience`` such
    epochs, and the best weights stay.
    """

    def __init__(self, trunk: int = 64, head: int = 32, epochs: int = 200, rate: float = 1e-3, least_rate: float = 1e-5, plateau: int = 3, patience: int = 10, batch: int = 512, share: float = 0.1, clip: float = 1.0, seed: int = 42):
        self.trunk, self.head, self.epochs, self.rate, self.least_rate = trunk, head, epochs, rate, least_rate
        self.plateau, self.patience, self.batch, self.share, self.clip, self.seed = plateau, patience, batch, share, clip, seed

    def fit(self, x: np.ndarray | Coded, t: np.ndarray, y: np.ndarray | Coded) -> ThreeHeads:
        rng = np.random.default_rng(self.seed)
        (z, self.mean, self.sd), (v, self.y_mean, self.y_sd) = coded(x).scaled(), coded(y).scaled()
        h, g, k = self.trunk, self.head, len(self.y_mean)
        shapes = {"a": (len(self.mean), h), "b": (h, h), "p": (h, 1), "g0": (h, g), "m0": (g, k), "g1": (h, g), "m1": (g, k)}
        self.w = {n: rng.standard_normal(s) * np.sqrt(2 / s[0]) for n, s in shapes.items()} | {f"{n}_": np.zeros(s[1]) for n, s in shapes.items()}
        held = np.zeros(len(t), dtype=bool)
        for arm in (0, 1):
            at = rng.permutation(np.nonzero(t == arm)[0])
            held[at[: max(1, round(self.share * len(at)))]] = True
        train, test, first, second = np.nonzero(~held)[0], np.nonzero(held)[0], {n: 0.0 for n in self.w}, {n: 0.0 for n in self.w}
        kept, waited, step, self.lr = self.w, 0, 0, self.rate
        self.best_loss, self.best_epoch, self.drops, self.train_first, self.train_best = np.inf, 0, 0, np.nan, np.inf
        for self.epochs_run in range(1, self.epochs + 1):
            order = rng.permutation(train)
            for a in range(0, len(order), self.batch):
                step += 1
                some = order[a : a + self.batch]
                grads = self._gradients(z[some], t[some], v[some])
                norm = np.sqrt(sum((q * q).sum() for q in grads.values()))
                for n, q in grads.items():
                    q = q * min(1.0, self.clip / max(norm, 1e-12))
                    first[n] = 0.9 * first[n] + 0.1 * q
                    second[n] = 0.999 * second[n] + 0.001 * q * q
                    self.w[n] = self.w[n] - self.lr * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
            fitted, loss = self._loss(z, t, v, train), self._loss(z, t, v, test)
            self.train_first = fitted if self.epochs_run == 1 else self.train_first
            if not np.isfinite(loss):
                break
            if loss < self.best_loss - 1e-5:
                self.best_loss, self.best_epoch, self.train_best, kept, waited = loss, self.epochs_run, fitted, dict(self.w), 0
                continue
            waited += 1
            if waited % self.plateau == 0 and self.lr > self.least_rate:
                self.lr, self.drops = max(self.least_rate, self.lr / 2), self.drops + 1
            if waited >= self.patience:
                break
        self.diverged = not np.isfinite(loss)
        self.w = kept
        usual = t[train].mean()

        def trivial(rows: np.ndarray) -> float:
            nothing = np.zeros((len(rows), k))
            return self._loss_of(np.full(len(rows), usual), nothing, nothing, t[rows], v[rows])

        self.trivial_loss = self._mean_loss(trivial, test)
        # A net that cannot beat the mean outcome and the mean treatment says nothing.
        self.degenerate = not self.best_loss < self.trivial_loss * 1.02
        self.useful = not (self.degenerate or self.diverged)
        return self

    def report(self) -> dict[str, float]:
        """What the fit went through."""
        return {
            "epochs_run": self.epochs_run, "best_epoch": self.best_epoch, "hit_cap": float(self.epochs_run == self.epochs), "lr_final": self.lr, "n_lr_drops": self.drops,
            "train_loss_first": self.train_first, "train_loss_best": self.train_best, "val_loss_best": self.best_loss, "val_loss_trivial": self.trivial_loss,
            "degenerate": float(self.degenerate), "diverged": float(self.diverged), "useful": float(self.useful),
        }

    def _layer(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.w[name] + self.w[f"{name}_"]

    def _forward(self, z: np.ndarray) -> dict[str, np.ndarray]:
        out = {"z": z, "h1": np.maximum(self._layer(z, "a"), 0)}
        out["h2"] = np.maximum(self._layer(out["h1"], "b"), 0)
        out["p"] = sigmoid(self._layer(out["h2"], "p"))[:, 0]
        for arm in "01":
            out[f"g{arm}"] = np.maximum(self._layer(out["h2"], f"g{arm}"), 0)
            out[f"m{arm}"] = self._layer(out[f"g{arm}"], f"m{arm}")
        return out

    @staticmethod
    def _loss_of(p, m0, m1, t, v) -> float:
        p = np.clip(p, 1e-6, 1 - 1e-6)
        own = np.where(t[:, None] == 1, m1, m0)
        return float(((own - v) ** 2).mean() - (t * np.log(p) + (1 - t) * np.log(1 - p)).mean())

    def _loss(self, z: Coded, t: np.ndarray, v: Coded, rows: np.ndarray) -> float:
        def loss(some: np.ndarray) -> float:
            out = self._forward(z[some])
            return self._loss_of(out["p"], out["m0"], out["m1"], t[some], v[some])

        return self._mean_loss(loss, rows)

    @staticmethod
    def _mean_loss(loss: Callable[[np.ndarray], float], rows: np.ndarray) -> float:
        """The mean over rows, ``SCORED`` at a time."""
        return sum(loss(some := rows[a : a + SCORED]) * len(some) for a in range(0, len(rows), SCORED)) / len(rows)

    def _gradients(self, z, t, v) -> dict[str, np.ndarray]:
        out, grads = self._forward(z), {}
        n, k = len(t), v.shape[1]

        def back(name: str, below: np.ndarray, above: np.ndarray) -> np.ndarray:
            """Gradients of a layer from those of its output; returns those of its input."""
            grads[name], grads[f"{name}_"] = below.T @ above, above.sum(axis=0)
            return above @ self.w[name].T

        shared = back("p", out["h2"], (out["p"] - t)[:, None] / n)
        for arm in "01":
            error = 2 * (out[f"m{arm}"] - v) * (t == int(arm))[:, None] / (n * k)
            inner = back(f"m{arm}", out[f"g{arm}"], error) * (out[f"g{arm}"] > 0)
            shared = shared + back(f"g{arm}", out["h2"], inner)
        below = back("b", out["h1"], shared * (out["h2"] > 0))
        back("a", z, below * (out["h1"] > 0))
        return grads

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Propensity and both arms' outcomes."""
        out = self._forward((x - self.mean) / self.sd)
        return out["p"], out["m0"] * self.y_sd + self.y_mean, out["m1"] * self.y_sd + self.y_mean
