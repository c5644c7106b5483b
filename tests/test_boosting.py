"""Boosted trees by histograms, and the estimators over them, against plain fits of one card at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cells import frame_of, plain_match

from tallyforge.operators import boosted, boosting, cells, learners, models
from tallyforge.operators.features import CORE

PROFILES = {"gbm_t": {"trees": 6, "rate": 0.2, "depth": 3, "leaf": 12}, "gbm_y": {"trees": 7, "rate": 0.1, "depth": 2, "leaf": 10}}


@pytest.fixture(scope="module")
def frame(spark, tmp_path_factory):
    """Two cards with few distinct covariates and one that cannot be fitted."""
    rows = frame_of(spark, np.random.default_rng(3), 700).unionByName(frame_of(spark, np.random.default_rng(4), 30, ("c",)).where("T = 0"))
    path = str(tmp_path_factory.mktemp("frame"))
    rows.repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rows_of(frame, binary):
    targets = {"T": "T"} if binary else {"g": "Y_g", "h": "Y_h"}
    return frame.fillna(0.0, list(CORE)).select("card_a", "draft_id", *CORE, F.lit(1).cast("long").alias("n"), *[F.col(c).cast("long").alias(f"s_{t}") for t, c in targets.items()]), list(targets)


@pytest.mark.parametrize("kept", [1, 4, 100])
@pytest.mark.parametrize("binary", [True, False])
def test_trees_are_those_of_the_plain_version(monkeypatch, frame, binary, kept):
    """Rows and weighted cells alike, whenever fitted values are written."""
    monkeypatch.setattr(boosting, "KEPT", kept)
    settings = PROFILES["gbm_t" if binary else "gbm_y"]
    rows, targets = rows_of(frame, binary)
    pdf = rows.toPandas()
    counted = rows.groupBy("card_a", *CORE).agg(F.sum("n").alias("n"), *[F.sum(f"s_{t}").alias(f"s_{t}") for t in targets])
    for table in (rows, counted):
        fit = boosting.boosted(table, CORE, targets, settings, binary=binary, keep=True)
        assert set(fit.trees) == {"a", "b", "c"}
        for card, part in pdf.groupby("card_a"):
            x = part[list(CORE)].to_numpy(dtype=float)
            bins = boosting.binned(x, fit.edges[card])
            f = boosting.added(np.repeat(fit.base[card][None], len(x), axis=0), fit.trees[card], bins, settings["rate"], settings["depth"])
            for i, t in enumerate(targets):
                plain = learners.Boosted(**settings, binary=binary).fit(x, part[f"s_{t}"].to_numpy(dtype=float)).predict(x)
                assert np.allclose(learners.sigmoid(f[:, i]) if binary else f[:, i], plain, atol=1e-9), (card, t)
    if binary:
        scored = boosting.scorer(fit, "p")(rows.select("card_a", "draft_id", *CORE)).toPandas()
        assert len(scored) == len(pdf) and scored["p"].between(0, 1).all() and scored["p"].nunique() > 10


def test_estimators_are_those_of_plain_fits(frame):
    names = list(models.BOOSTED)
    found = {(r["method"], r["card_a"], r["group_b"]): r["value"] for r in models.estimate(frame, ["g", "h"], names, models.PROFILES | PROFILES).collect()}
    assert len(found) == 4 * 3 * 2 and all(v is None for (_, card, _), v in found.items() if card == "c")
    whole = frame.toPandas().fillna(0.0)
    for card, pdf in whole[whole["card_a"] != "c"].groupby("card_a"):
        x, t, offered = pdf[list(CORE)].to_numpy(dtype=float), pdf["T"].to_numpy() == 1, pdf["not_offered"].to_numpy() == 0
        e = offered.mean() * learners.Boosted(**PROFILES["gbm_t"], binary=True).fit(x[offered], t[offered].astype(float)).predict(x)
        w = np.minimum(e[~t], 0.999) / (1 - np.minimum(e[~t], 0.999))
        w /= w.sum()
        near = plain_match(pdf.assign(e=np.round(e * 1e7)), lambda row, c: (c["e"] - row["e"]).abs(), 3)
        for i, g in enumerate("gh"):
            y = pdf[f"Y_{g}"].to_numpy(dtype=float)
            r = y - learners.Boosted(**PROFILES["gbm_y"], binary=False).fit(x[~t], y[~t]).predict(x)
            assert found["sipw_gbm", card, g] == pytest.approx(y[t].mean() - w @ y[~t])
            assert found["match_ps_gbm_k3", card, g] == pytest.approx(near[i])
            assert found["dm_impute_t_att_gbm", card, g] == pytest.approx(r[t].mean())
            assert found["dr_att_gbm", card, g] == pytest.approx(r[t].mean() - w @ r[~t])


def test_no_card_can_be_fitted(frame):
    lone = frame.where("card_a = 'c'")
    rows = models.estimate(lone, ["g"], list(models.BOOSTED), models.PROFILES | PROFILES).collect()
    assert len(rows) == 4 and all(r["value"] is None for r in rows)


def test_no_task_holds_a_card(frame):
    """A card's rows lie in several blocks, and control cells are the frame's."""
    counted = cells.from_frame(frame, ["g", "h"])
    table = boosted.controls(counted, ["a", "b"])
    assert table.agg(F.sum("n")).first()[0] == frame.where("T = 0 and card_a <> 'c'").count()
    fit = boosting.boosted(rows_of(frame, False)[0], CORE, ["g", "h"], {"trees": 1, "rate": 0.1, "depth": 1, "leaf": 5})
    assert fit.blocks.where("card_a = 'a'").count() > 1


def test_blocks_follow_the_rows_not_the_partitions(spark, monkeypatch, frame):
    """Few rows make two blocks a card, however many partitions a shuffle has; more rows make more, with the same trees."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    rows, targets = rows_of(frame, False)
    found = []
    try:
        for partitions, room in ((37, boosting.ROOM), (4, 5_000)):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            monkeypatch.setattr(boosting, "ROOM", room)
            found.append(boosting.boosted(rows, CORE, targets, PROFILES["gbm_y"], keep=True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    few, many = (f.blocks.groupBy("card_a").count().toPandas().set_index("card_a")["count"] for f in found)
    assert (few == 2).all() and (many > 2).any()
    assert all(np.allclose(found[0].trees[card], t) for card, t in found[1].trees.items())


def test_imputation_fits_no_propensity(frame, monkeypatch):
    """Only the doubly robust estimator needs one; the trees then score all rows by themselves."""

    def refuse(*_):
        raise AssertionError("a propensity")

    monkeypatch.setattr(boosted, "propensity", refuse)
    rows = models.estimate(frame, ["g", "h"], ["dm_impute_t_att_gbm"], models.PROFILES | PROFILES).collect()
    assert len(rows) == 6 and sum(r["value"] is not None for r in rows) == 4


def test_blocks_are_joint_keys_and_only_the_last_are_kept(frame, monkeypatch):
    """Blocks hold no column by itself, whole small numbers take a byte, and tables before the last are gone."""
    gone, discard = [], boosting.discard
    monkeypatch.setattr(boosting, "discard", lambda spark, path: gone.append(path) or discard(spark, path))
    monkeypatch.setattr(boosting, "KEPT", 1)
    rows, targets = rows_of(frame, False)
    fit = boosting.boosted(rows, CORE, targets, {"trees": 3, "rate": 0.1, "depth": 2, "leaf": 5})
    first = fit.blocks.first()
    n = len(first["f"]) // (8 * len(targets))
    assert len(first["keys"]) == 2 * n * len(fit.layout.parts) < 2 * n * len(CORE) and len(first["n"]) == 8 + n
    assert len(gone) == 3 * 3 and fit.blocks.count() == 6


def test_places_and_values_of_a_tree_that_stops_early():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 6, (500, 3)).astype(np.uint8)
    tree = np.zeros((15, 3))
    tree[:, 0], tree[:, 2] = -1, rng.random(15)
    for node, column, cut in ((0, 1, 2), (2, 0, 3), (5, 2, 1)):
        tree[node, :2] = column, cut

    def plain(row):
        node = 0
        while tree[node, 0] >= 0:
            node = 2 * node + 1 + int(row[int(tree[node, 0])] > tree[node, 1])
        return tree[node, 2]

    found = boosting.added(np.zeros((500, 1)), tree[None, None], bins, 1.0, 3)[:, 0]
    assert np.allclose(found, [plain(r) for r in bins])
