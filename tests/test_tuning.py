"""The tuner over coded rows, and tree learners that hold no matrix as wide as the rows."""

import numpy as np
import pandas as pd
from test_nets import in_batches
from test_cells import frame_of

from tallyforge.operators import estimators, learners, models
from tallyforge.operators.features import CORE


def test_boosted_and_propensity_losses_on_codes_are_those_of_matrices(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 9, 900), rng.integers(0, 300, 900) / 7, np.ones(900)])
    y = x[:, 0] + rng.random(900)
    whole = learners.Boosted(4, 0.1, 3, 10, binary=False).fit(x, y)
    monkeypatch.setattr(learners.Coded, "__getitem__", None)
    parts = learners.Boosted(4, 0.1, 3, 10, binary=False).fit(in_batches(x, 250), y)
    assert parts.binner(in_batches(x, 250)).dtype == np.uint8
    assert np.array_equal(whole.predict(x), parts.predict(in_batches(x, 250)))


def test_tuner_takes_no_frame_of_a_card(spark, monkeypatch):
    rows = frame_of(spark, np.random.default_rng(8), 300).cache()

    def refuse(*_, **__):
        raise AssertionError("a card's frame")

    monkeypatch.setattr(models, "per_card", refuse)
    monkeypatch.setattr(estimators, "per_card", refuse)
    settings = {"trees": 3, "rate": 0.1, "depth": 2, "leaf": 10}
    for profile, groups in (("gbm_t", []), ("gbm_y", ["g", "h"]), ("logit", [])):
        point = settings if profile != "logit" else {"c": 0.35}
        found = models.tuned(rows, groups, profile, [point]).first()
        loss = n = 0
        for card, pdf in rows.toPandas().sort_values("draft_id").groupby("card_a"):
            c = models.Context(pdf.reset_index(drop=True), list(CORE))
            test = models.held_out_rows(c, 0, 0.3)
            if profile == "gbm_y":
                fit, to = ~c.treated & ~test, ~c.treated & test
                for g in groups:
                    loss += ((learners.Boosted(**point, binary=False).fit(c.core[fit], c.y(g)[fit]).predict(c.core[to]) - c.y(g)[to]) ** 2).sum()
                    n += to.sum()
            else:
                fit, to = c.offered & ~test, c.offered & test
                model = learners.Logit(**point) if profile == "logit" else learners.Boosted(**point, binary=True)
                loss += ((model.fit(c.core[fit], c.t[fit]).predict(c.core[to]) - c.t[to]) ** 2).sum()
                n += to.sum()
        assert found["n_rows"] == n and np.isclose(found["loss"], loss / n)


def test_nuisances_are_fitted_once_for_all_candidates(monkeypatch):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({c: rng.integers(0, 5, n).astype(float) for c in CORE} | {"card_a": "a", "T": rng.integers(0, 2, n), "not_offered": 0, "Y_g": rng.random(n)})
    c, test = models.Context(pdf, list(CORE)), rng.random(n) < 0.3
    fits, fit = [], learners.Forest.fit
    monkeypatch.setattr(learners.Forest, "fit", lambda self, *a: fits.append(self.honest) or fit(self, *a))
    losses = [models.residual_loss(c, ["g"], {"trees": 3, "depth": 2, "leaf": leaf}, test)["loss"] for leaf in (10, 30)]
    assert fits == [False, False, True, True] and losses[1] == models.residual_loss(models.Context(pdf, list(CORE)), ["g"], {"trees": 3, "depth": 2, "leaf": 30}, test)["loss"]


def test_candidates_that_differ_in_trees_are_one_fit(spark, monkeypatch):
    """One fit a group for all numbers of trees, over bins made once, with the losses of fits by themselves."""
    rows = frame_of(spark, np.random.default_rng(8), 300).where("card_a = 'a'").toPandas().fillna(0.0).sort_values("draft_id")
    x, y, settings = rows[list(CORE)].to_numpy(dtype=float), rows[["Y_g", "Y_h"]].to_numpy(dtype=float), {"rate": 0.1, "depth": 2, "leaf": 10}
    c = models.CodedContext(estimators.CardRows("a", rows["T"].to_numpy(), rows["not_offered"].to_numpy() == 0, in_batches(x, 99), in_batches(y, 99)), list(CORE), ["g", "h"])
    c.points = [settings | {"trees": n} for n in (4, 9, 2)]
    test, fits, binners, fit, binner = models.held_out_rows(c, 0, 0.3), [], [], learners.Boosted.fit, learners.Binner.__init__
    monkeypatch.setattr(learners.Boosted, "fit", lambda self, *a: fits.append(self.n) or fit(self, *a))
    monkeypatch.setattr(learners.Binner, "__init__", lambda self, *a: binners.append(1) or binner(self, *a))
    losses = [models.outcome_loss(c, ["g", "h"], p, test)["loss"] for p in c.points]
    assert fits == [9, 9] and len(binners) == 1
    a, b = ~c.treated & ~test, ~c.treated & test
    for p, loss in zip(c.points, losses, strict=True):
        alone = sum(((learners.Boosted(**p, binary=False).fit(x[a], v[a]).predict(x[b]) - v[b]) ** 2).sum() for v in y.T)
        assert np.isclose(loss, alone)
