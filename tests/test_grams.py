"""Double learning from Gram matrices by fold, against SQL and a row-by-row version."""

import hashlib

import numpy as np
import pytest
from test_cells import duck, frame_of  # noqa: F401
from test_core import SF, values

from tallyforge.operators import cells, grams, models
from tallyforge.operators.features import CORE
from tallyforge.plans import oracle, queries


def test_query_equals_sql(spark, duck):  # noqa: F811
    """The SQL fits each fold's complement by elimination and predicts row by row."""
    found, wanted = queries.QUERIES["dml"](spark, SF).toPandas(), duck.sql(oracle.SQL["dml"]).df()
    assert found["value"].notna().any() and values(found) == values(wanted)


@pytest.mark.parametrize("folds", [2, 5])
def test_folds_against_rows(spark, folds):
    frame = frame_of(spark, np.random.default_rng(folds), 200)
    found = {(r["card_a"], r["group_b"]): r["value"] for r in grams.double_learning(cells.from_frame(frame, ["g", "h"]), folds=folds).collect()}
    assert len(found) == 4
    for card, pdf in frame.toPandas().fillna(0.0).groupby("card_a"):
        x = np.column_stack([np.ones(len(pdf)), pdf[list(CORE)].to_numpy(dtype=float)])
        fold = np.array([int(hashlib.md5(f"42:{d}".encode()).hexdigest()[:8], 16) % folds for d in pdf["draft_id"]])
        ridge = np.diag([0.0] + [1.0] * len(CORE))

        def rest(v, x=x, fold=fold, ridge=ridge):
            out = np.empty(len(v))
            for k in range(folds):
                a, b = fold != k, fold == k
                out[b] = v[b] - x[b] @ np.linalg.solve(x[a].T @ x[a] + ridge, x[a].T @ v[a])
            return out

        t = rest(pdf["T"].to_numpy(dtype=float))
        for g in "gh":
            assert found[card, g] == pytest.approx((rest(pdf[f"Y_{g}"].to_numpy(dtype=float)) * t).sum() / (t**2).sum())


def test_too_few_rows_give_null(spark):
    lone = frame_of(spark, np.random.default_rng(1), 40, ("a",)).where("T = 0")
    assert [r["value"] for r in models.estimate(lone, ["g"], ["dml"]).collect()] == [None]
