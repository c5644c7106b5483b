"""Forests over coded rows: every control is read, and joint histograms give the sums of single columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import estimators, learners, models
from tallyforge.operators.features import CORE


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A card with more controls than the sample of 50,000 that forests once took."""
    rng, n = np.random.default_rng(6), 70_000
    cols = {c: rng.integers(0, 5, n).astype(float) for c in CORE}
    offered, t = np.arange(n) % 3 == 0, np.arange(n) % 150 == 0
    pdf = pd.DataFrame({"card_a": "k", "draft_id": np.arange(n), "T": t.astype(int), "not_offered": (~offered).astype(int), "Y_g": rng.integers(0, 4, n) + 2 * t, **cols})
    path = str(tmp_path_factory.mktemp("many"))
    spark.createDataFrame(pdf).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), pdf


@pytest.fixture
def no_frames(monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a card's frame")

    monkeypatch.setattr(models, "per_card", refuse)
    monkeypatch.setattr(estimators, "per_card", refuse)


def test_forest_diagnostics_read_every_control(many, no_frames):
    frame, pdf = many
    found = {r["figure"]: r["value"] for r in models.forest_diagnostics(frame, ["g"]).collect()}
    t, y = pdf["T"] == 1, pdf["Y_g"]
    assert found["naive"] == pytest.approx(y[t].mean() - y[~t].mean(), abs=1e-12)
    x, v = pdf[list(CORE)].to_numpy(dtype=float), pdf["T"].to_numpy(dtype=float)
    fold, rt = models.folds(len(v), 3), np.empty(len(v))
    for i in range(3):
        rt[fold == i] = v[fold == i] - learners.Forest(**models.PROFILES["nuisance"]).fit(x[fold != i], v[fold != i]).predict(x[fold == i])
    assert found["t_share"] == pytest.approx(rt.var() / v.var(), abs=1e-9)
    assert models.estimate(frame, ["g"], ["cf_att"]).first()["value"] == pytest.approx(found["tau_att"], abs=1e-9)


def test_forest_tuning_reads_every_control(many, no_frames):
    frame, pdf = many
    found = models.tuned(frame, ["g"], "forest", [{"trees": 2, "depth": 2}]).first()
    c = models.Context(pdf, list(CORE))
    test = models.held_out_rows(c, 0, 0.3)
    assert found["n_rows"] == test.sum() == round(0.3 * c.treated.sum()) + round(0.3 * (~c.treated).sum())
    assert found["loss"] == pytest.approx(models.residual_loss(c, ["g"], models.PROFILES["forest"] | {"trees": 2, "depth": 2}, test)["loss"] / test.sum(), abs=1e-9)


def test_joint_sums_are_those_of_columns():
    rng, n = np.random.default_rng(7), 9000
    x = np.column_stack([rng.integers(0, k, n) for k in (3, 300, 9, 1, 12, 5, 70)]).astype(float)
    rows, w = learners.Binned(learners.coded(x)), rng.random(n)
    assert len(rows.layout.parts) < x.shape[1] and np.array_equal(rows.bins, learners.Binner(x)(x))
    few, node = np.arange(0, n, 3), rng.integers(0, 3, n)
    plain = lambda at, v: np.concatenate([np.bincount(rows.bins[at, j], weights=None if v is None else v[at], minlength=k) for j, k in enumerate(rows.layout.sizes)])
    for at in (np.arange(n), few):
        for found, v in zip(rows.sums(at, [None, w]), (None, w), strict=True):
            assert np.allclose(found, plain(at, v))
    by_node = rows.layout.sums(list(rows.keys), [None, w], node, 3)
    assert all(np.allclose(by_node[i, q], plain(np.flatnonzero(node == q), v)) for i, v in enumerate((None, w)) for q in range(3))
