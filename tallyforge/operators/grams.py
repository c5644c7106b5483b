"""Cross-fitted linear nuisances from Gram matrices by fold.

One pass sums the Gram matrices of [1, covariates, outcomes] by pool and fold, another those of what each card held
or was treated with. A card's fold is its pool's less what it held; treated rows alone make up the treatment's
column. What a fit without a fold needs is the sum of all less that fold's, and sums of products of residuals
are quadratic forms of the fold's matrix, so no row is read twice and none is ever predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import LEAST, Cells, all_pairs

FOLDS = 5


def fold_of(draft_id: Column, folds: int = FOLDS, seed: int = 42) -> Column:
    """The fold of a draft, by hash: the same for all cards."""
    text = F.concat_ws(":", F.lit(str(seed)), draft_id.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % folds


def summed(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and ``gram``: the Gram matrix of [1, columns]. Each Arrow batch is reduced to matrices, which are added up by key."""
    width = len(columns) + 1
    types = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            m = np.column_stack([np.ones(len(pdf)), pdf[columns].to_numpy(dtype=float)])
            for key, at in pdf.groupby(keys).indices.items():
                total[key] = total.get(key, 0) + m[at].T @ m[at]
        yield pd.DataFrame([(*k, v.tobytes()) for k, v in total.items()], columns=[*keys, "gram"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = sum(np.frombuffer(b).reshape(width, width) for b in pdf["gram"])
        return pdf[keys].head(1).assign(gram=[gram.tobytes()])

    form = f"{types}, gram binary"
    return rows.select(*keys, *columns).mapInPandas(reduce, form).groupBy(*keys).applyInPandas(add, form)


def partialled(folds: np.ndarray, p: int, alpha: float) -> np.ndarray:
    """Coefficients of outcome on treatment, both less what ridge fits on the other folds predict for them.

    ``folds``: Gram matrices of [1, covariates, treatment, outcomes] by fold; ``p`` counts the first two.
    """
    ridge = alpha * np.diag([0.0] + [1.0] * (p - 1))
    total, over, under = folds.sum(axis=0), 0.0, 0.0
    for gram in folds:
        rest = total - gram
        beta = np.linalg.solve(rest[:p, :p] + ridge, rest[:p, p:])
        # Residuals are the columns from p on less their predictions.
        u = np.vstack([-beta, np.eye(gram.shape[0] - p)])
        products = u.T @ gram @ u
        over, under = over + products[0, 1:], under + products[0, 0]
    return over / under if under > 1e-12 else np.full(folds.shape[1] - p - 1, np.nan)


def double_learning(cells: Cells, *, folds: int = FOLDS, alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """method, card_a, group_b, value by double learning with ridge nuisances (intercept free, penalty ``alpha``).

    All drafts of a card's frame count. Null where fewer than ``LEAST`` are treated or controls, where all rows
    of a kind are in one fold, or where nothing of the treatment is left.
    """
    groups, columns = cells.groups, [*cells.names, *[f"Y_{g}" for g in cells.groups]]
    fold = fold_of(F.col("draft_id"), folds, seed).alias("fold")
    pools = summed(cells.drafts().select("*", fold), ["pool", "fold"], columns)
    own_rows = cells.gone.join(F.broadcast(cells.cards), "card_a").join(cells.drafts(), ["pool", "draft_id"]).select("*", fold)
    own = summed(own_rows, ["card_a", "fold", "treated"], columns)
    # A card has as many matrices as folds and kinds.
    kinds = F.broadcast(cells.cards).join(pools, "pool").select("card_a", "fold", F.lit("pool").alias("kind"), "gram")
    kinds = kinds.unionByName(own.select("card_a", "fold", F.when(F.col("treated"), "t").otherwise("h").alias("kind"), "gram"))
    width, p = len(columns) + 1, len(cells.names) + 1

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out, treated = np.zeros((folds, width + 1, width + 1)), np.zeros(folds)
        rest = [*range(p), *range(p + 1, width + 1)]
        for r in pdf.itertuples():
            gram, mine = np.frombuffer(r.gram).reshape(width, width), out[r.fold]
            if r.kind == "t":
                mine[p, rest] = mine[rest, p] = gram[0]
                mine[p, p] = treated[r.fold] = gram[0, 0]
            else:
                mine[np.ix_(rest, rest)] += gram if r.kind == "pool" else -gram
        n = out[:, 0, 0]
        enough = treated.sum() >= LEAST and n.sum() - treated.sum() >= LEAST and (n > 0).sum() > 1
        values = partialled(out, p, alpha) if enough else np.full(len(groups), np.nan)
        return pd.DataFrame({"card_a": pdf["card_a"].iloc[0], "group_b": groups, "value": values})

    found = kinds.groupBy("card_a").applyInPandas(solve, "card_a string, group_b string, value double").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    return all_pairs(cells, "dml").join(found, ["card_a", "group_b"], "left").select("method", "card_a", "group_b", "value")
