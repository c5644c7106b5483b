"""Weighted cells, logistic fits as sums, and nearest-neighbour joins, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_core import SF, TABLES, values  # noqa: F401

from tallyforge.operators import cells, features, learners, models, neighbours
from tallyforge.operators.features import CORE
from tallyforge.plans import oracle, queries
from tallyforge.sources.tables import order_facts


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def x(spark):
    return order_facts(spark, SF)


@pytest.mark.parametrize("name", ["sipw_logit", "match_ps_logit_k3"])
def test_query_equals_sql(spark, duck, name):
    """The SQL solves its own Newton steps by elimination."""
    assert values(queries.QUERIES[name](spark, SF).toPandas()) == values(duck.sql(oracle.SQL[name]).df())


def test_cells_of_facts_are_those_of_the_frame(spark, x):
    """The sparse form with complement against the dense frame: numbers and sums of controls by card and cell."""
    groups = features.groups_of(x)
    sparse = cells.from_facts(x, groups)
    dense = features.frame(x, groups).fillna(0.0, list(CORE)).where("T = 0").groupBy("card_a", *CORE).agg(F.count("*").alias("n"), *[F.sum(f"Y_{g}").alias(f"s_{g}") for g in groups])
    own = sparse.own.select("card_a", "pool", *CORE, (F.col("n_t") + F.col("n_h")).alias("less"), *[(F.col(f"t_{g}") + F.col(f"h_{g}")).alias(f"less_{g}") for g in groups])
    net = sparse.cards.join(sparse.pool, "pool").join(own, ["card_a", "pool", *CORE], "left").fillna(0)
    net = net.select("card_a", *CORE, (F.col("n") - F.col("less")).alias("n"), *[(F.col(f"s_{g}") - F.col(f"less_{g}")).alias(f"s_{g}") for g in groups]).where("n > 0")
    rows = lambda df: sorted(tuple(r) for r in df.select(*dense.columns).collect())
    assert rows(net) == rows(dense)
    again = cells.from_frame(features.frame(x, groups), groups)
    assert cells.sizes(again) == cells.sizes(sparse)


def test_newton_steps_are_the_plain_fit(spark, x):
    groups = features.groups_of(x)
    frame = features.frame(x, groups)
    fits = cells.logistic(cells.from_facts(x, groups))
    assert len(fits) > 5
    for card in sorted(fits)[:5]:
        pdf = frame.where((F.col("card_a") == card) & (F.col("not_offered") == 0)).select("T", *CORE).toPandas()
        plain = learners.Logit(c=0.35).fit(pdf[list(CORE)].to_numpy(dtype=float), pdf["T"].to_numpy(dtype=float))
        assert np.allclose(fits[card]["w"], plain.w, atol=1e-6) and np.allclose(fits[card]["sd"], plain.sd)


def frame_of(spark, rng, n, cards=("a", "b")):
    """Few distinct covariates, so that ties are common; a constant one; nulls."""
    rows = []
    for card in cards:
        for i in range(n):
            core = [float(rng.integers(0, 3)) / 2, 0.1, *(float(v) for v in rng.integers(0, 4, 6))]
            core[3] = None if rng.random() < 0.1 else core[3]
            rows.append((card, i, int(rng.random() < 0.15), int(rng.random() < 0.5), *core, int(rng.integers(0, 5)), int(rng.integers(0, 2))))
    rows = [(*r[:3], 0 if r[2] else r[3], *r[4:]) for r in rows]
    return spark.createDataFrame(rows, "card_a string, draft_id long, T int, not_offered int, " + ", ".join(f"{c} double" for c in CORE) + ", Y_g long, Y_h long")


def plain_match(pdf, distance, k):
    t, c = pdf[pdf["T"] == 1], pdf[pdf["T"] == 0]
    gaps = []
    for _, row in t.iterrows():
        near = c.assign(d=distance(row, c)).sort_values(["d", "draft_id"]).head(k)
        gaps.append([row[y] - near[y].mean() for y in ("Y_g", "Y_h")])
    return np.mean(gaps, axis=0)


@pytest.mark.parametrize("box", [1_000, 2])
@pytest.mark.parametrize("k", [1, 3, 40])
def test_neighbours_against_all_pairs(spark, monkeypatch, box, k):
    """One box and many; more neighbours than a cell, a box or nearly all controls hold."""
    monkeypatch.setattr(neighbours, "BOX_POINTS", box)
    frame = frame_of(spark, np.random.default_rng(k), 120)
    counted = cells.from_frame(frame, ["g", "h"])
    whole = frame.toPandas().fillna(0.0)
    found = {(r["card_a"], r["group_b"]): r["value"] for r in neighbours.match_covariates(counted, k).collect()}
    for card, pdf in whole.groupby("card_a"):
        x = pdf[list(CORE)].to_numpy(dtype=float)
        sd = x.std(axis=0)
        z = np.where(sd > 1e-12, (x - x.mean(axis=0)) / np.where(sd > 1e-12, sd, 1), 0)
        pdf = pdf.assign(z=list(z))
        plain = plain_match(pdf, lambda row, c: (np.stack(c["z"]) - row["z"][None]).__pow__(2).sum(axis=1).round(9), k)
        assert [found[card, "g"], found[card, "h"]] == pytest.approx(plain)
    of = cells.logistic(counted)
    scored = {(r["card_a"], r["group_b"]): r["value"] for r in neighbours.match_scores(counted, k).collect()}
    for card, pdf in whole.groupby("card_a"):
        eta = ((pdf[list(CORE)].to_numpy(dtype=float) - of[card]["mean"]) / of[card]["sd"]) @ of[card]["w"][:-1] + of[card]["w"][-1]
        pdf = pdf.assign(e=np.round(of[card]["share"][0] / (1 + np.exp(-eta)) * 1e7))
        assert [scored[card, "g"], scored[card, "h"]] == pytest.approx(plain_match(pdf, lambda row, c: (c["e"] - row["e"]).abs(), k))


def test_fewer_controls_than_neighbours_and_cards_without_treated(spark):
    frame = frame_of(spark, np.random.default_rng(9), 12, ("a",)).where("T = 1 or draft_id < 6")
    lone = frame_of(spark, np.random.default_rng(9), 10, ("b",)).where("T = 0")
    counted = cells.from_frame(frame.unionByName(lone), ["g", "h"])
    rows = {(r["card_a"], r["group_b"]): r["value"] for r in neighbours.match_covariates(counted, 50).collect()}
    pdf = frame.toPandas()
    assert rows["a", "g"] == pytest.approx(pdf[pdf["T"] == 1]["Y_g"].mean() - pdf[pdf["T"] == 0]["Y_g"].mean())
    assert rows["b", "g"] is None and len(rows) == 4
    assert all(r["value"] is None for r in cells.weighted(counted).collect())
    assert all(r["value"] is None for r in neighbours.match_scores(counted).collect())


def test_estimates_of_some_cards_are_those_of_all(spark, x):
    groups = features.groups_of(x)
    every = cells.from_facts(x, groups)
    cards = every.cards.orderBy("card_a").limit(4).select("card_a")
    some = cells.only(every, cards)
    key = lambda df: {(r["card_a"], r["group_b"]): r["value"] for r in df.collect()}
    a, b = key(cells.weighted(some)), key(cells.weighted(every))
    assert len(a) == 4 * len(groups) and all(v == pytest.approx(b[k]) for k, v in a.items() if v is not None)
    assert models.chosen(["match_ps_logit_k3", "sipw_logit"]) == ["sipw_logit", "match_ps_logit_k3"]


def test_boxes_are_cut_on_any_covariate(spark, monkeypatch):
    """Where only the last covariates differ, a treated cell still meets few of the points."""
    monkeypatch.setattr(neighbours, "BOX_POINTS", 20)
    rng = np.random.default_rng(5)
    rows = [("a", i, int(i % 8 == 0), 0, *([0.5] * 6), *(float(v) for v in rng.random(2)), int(rng.integers(0, 5)), int(rng.integers(0, 2))) for i in range(1200)]
    frame = spark.createDataFrame(rows, "card_a string, draft_id long, T int, not_offered int, " + ", ".join(f"{c} double" for c in CORE) + ", Y_g long, Y_h long")
    distances, whole = [], neighbours.nearest_points

    def watched(space, met, k):
        held = space.points.groupBy(space.key, "box").agg(F.count("*").alias("held"))
        distances.append(met.join(held, [space.key, "box"]).agg(F.sum("held")).first()[0])
        return whole(space, met, k)

    monkeypatch.setattr(neighbours, "nearest_points", watched)
    found = {r["group_b"]: r["value"] for r in neighbours.match_covariates(cells.from_frame(frame, ["g", "h"])).collect()}
    pdf = frame.toPandas()
    z = pdf[list(CORE[6:])]
    pdf = pdf.assign(z=list(((z - z.mean()) / z.std(ddof=0)).to_numpy()))
    plain = plain_match(pdf, lambda row, c: ((np.stack(c["z"]) - row["z"][None]) ** 2).sum(axis=1).round(9), 3)
    assert [found["g"], found["h"]] == pytest.approx(plain)
    assert len(distances) == 2 and sum(distances) < 0.2 * 150 * 1200
