"""Queries against their SQL, invariants, and sources."""

import json
import math
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.operators import exclusion, facts, fdr, features, iv, learners, metrics, models, resample
from tallyforge.operators.estimators import match_cov, nearest, per_card, ridge_imputation, scaled
from tallyforge.plans import oracle, queries
from tallyforge.report import cell, scores_table, sensitivity_table, spearman_table
from tallyforge.sources import drafts
from tallyforge.sources.tables import Facts, order_facts, pack_offers
from tallyforge.streaming.merge import merge_batches, merged

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "part")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def values(df):
    norm = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted([tuple(norm(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)], key=str)


QUICK = ("reference_effects", "iv_sufficient_stats", "pick_stats", "unknown_picks", "pack_length_hist", "draft_accounting", "history_features", "estimation_frame", "balance_smd", "exact_match_exclusion", "satt_offered", "match_cov_k3", "method_scores", "bh_reject", "bootstrap_intervals", "significance_matrix", "rank_spearman", "group_labels", "mana_pips", "mana_value", "grid_decode", "exclusion_summary", "rank_separation_fdr", "split_in_order", "merged_effects", "page_chain_cards")


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    assert values(queries.QUERIES[name](spark, SF).toPandas()) == values(duck.sql(oracle.SQL[name]).df())


def test_every_sql_has_a_query():
    assert set(oracle.SQL) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def x(spark):
    return order_facts(spark, SF)


def test_accounting_adds_up(x):
    reached = facts.lengths(x.picks).where("reached").count()
    for r in facts.draft_accounting(x).collect():
        assert r["n_valid"] + r["n_invalid"] + r["n_incomplete"] + r["n_no_outcome"] == reached
        assert r["horizon_min"] == r["horizon_max"] == 10


def test_itt_d_is_the_treated_share(x):
    for r in iv.reference_effects(x).collect():
        assert r["itt_d"] == pytest.approx(r["n_treated"] / r["n_offered"])


def test_histogram_counts_drops(x):
    hist = facts.pack_length_hist(x.picks).collect()
    assert sum(r["n_drafts"] for r in hist) == facts.lengths(x.picks).count()


def log_of(spark, tmp_path):
    rows = []
    for d, lens in (("a", (2, 2, 2)), ("b", (2, 2, 1)), ("c", (2, 2, 2))):
        for pack, n in enumerate(lens):
            for k in range(n):
                rows.append((d, pack, k, ["Ax, the 'First'", "B // C"][k % 2], {0: "1", 1: "2.0"}[k], "1" if d == "c" else "", "0"))
    path = tmp_path / "log.csv"
    pd.DataFrame(rows, columns=["draft_id", "pack_number", "pick_number", "pick", "pack_card_Ax, the 'First'", "pack_card_B // C", "pool_x"]).to_csv(path, index=False)
    return str(path)


def test_wide_log(spark, tmp_path):
    log = drafts.read_log(spark, log_of(spark, tmp_path))
    cards = spark.createDataFrame([("Ax, the 'First'", "R"), ("B // C", "G")], "card string, group_b string")
    f = drafts.facts(log, cards)
    assert {(r["draft_id"], r["complete"]) for r in facts.lengths(f.picks).collect()} == {("a", True), ("b", False), ("c", True)}
    offers = {(r["draft_id"], r["pack"], r["card"]): (r["n_first"], r["n_rows"]) for r in f.offers.collect()}
    assert offers["a", 0, "Ax, the 'First'"] == (1, 2) and ("a", 0, "B // C") not in offers and offers["c", 1, "B // C"] == (1, 2)
    with pytest.raises(ValueError):
        drafts.card_columns(log, ["other"])
    with pytest.raises(ValueError):
        drafts.card_columns(log.drop("pick"))


def test_card_json(spark, tmp_path):
    for i, name in enumerate(("p1", "p2")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"data": [{"name": "A", "cmc": float(i), "colors": ["R"]}, {"name": f"only {i}", "cmc": 3.0}]}))
    cards = drafts.read_card_pages(spark, [str(tmp_path / "p1.json"), str(tmp_path / "p2.json")])
    assert {r["name"]: r["cmc"] for r in cards.collect()} == {"A": 1.0, "only 0": 3.0, "only 1": 3.0}
    (tmp_path / "g.json").write_text(json.dumps({"A": "R_Creature"}))
    assert [tuple(r) for r in drafts.read_groups(spark, str(tmp_path / "g.json")).collect()] == [("A", "R_Creature")]


def test_runs_and_halves(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2), ("a", 3)], "draft_id string, row_pos int")
    assert drafts.runs(rows).select("draft_id").distinct().count() == 3
    ids = spark.range(200).withColumnRenamed("id", "draft_id")
    assert {r[0] for r in ids.select(facts.split_half(F.col("draft_id"))).distinct().collect()} == {0, 1}
    import random

    rng = random.Random(5)
    expected = [int(rng.random() >= 0.5) for _ in range(50)]
    got = facts.split_in_order(spark.range(50).select(F.col("id").alias("draft_id"), F.col("id").alias("position")).repartition(3), 5)
    assert [r["half"] for r in got.orderBy("draft_id").collect()] == expected


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.floats(0, 1), st.none()), min_size=1, max_size=15))
def test_benjamini_hochberg(spark, ps):
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
    out = {r["i"]: (r["q"], r["reject"]) for r in fdr.benjamini_hochberg(df, "p", [F.lit(0)], ["i"]).collect()}
    some = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    low = 1.0
    for rank in range(len(some), 0, -1):
        p, i = some[rank - 1]
        low = min(low, p * len(some) / rank)
        assert out[i][0] == pytest.approx(low) and out[i][1] == any(q <= 0.05 * (k + 1) / len(some) for k, (q, _) in enumerate(some) if k + 1 >= rank)
    assert all(out[i] == (None, False) for i, p in enumerate(ps) if p is None)


def scoring_rows(spark, scale=0.5, n=40):
    rng = np.random.default_rng(1)
    t = rng.standard_normal(n)
    t -= t.mean()
    rows = [("m", f"c{i % 8}", f"g{i}", float(scale * v), float(v), 0.3) for i, v in enumerate(t)]
    rows += [("zero", f"c{i % 8}", f"g{i}", 0.0, float(v), 0.3) for i, v in enumerate(t)] + [("bad", "c0", "g0", float("nan"), 1.0, 0.3)]
    return spark.createDataFrame(rows, "method string, card_a string, group_b string, value double, late double, se_late double")


def test_concordance_of_a_scaled_estimate(spark):
    out = {r["method"]: r for r in metrics.method_scores(scoring_rows(spark)).collect()}
    assert out["m"]["ccc"] == pytest.approx(2 * 0.5 / (1 + 0.25)) and out["zero"]["ccc"] == pytest.approx(0) and "bad" not in out


def test_weights_equal_copied_rows(spark):
    rows = metrics.centred(metrics.usable(scoring_rows(spark))).withColumn("cluster", F.col("card_a"))
    w = resample.weights(rows.select("cluster").distinct(), 3, 0)
    copied = rows.join(w, "cluster").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).where("rep = 1")
    direct = {r["method"]: r["rmse"] for r in metrics.method_scores(copied.drop("centre", "k", "rep", "w", "cluster")).collect()}
    m = rows.groupBy("method", "cluster").agg(*metrics.moment_columns(F.col("value"), F.col("centre")))
    sums = m.join(w.where("rep = 1"), "cluster").groupBy("method").agg(*[F.sum(F.col(k) * F.col("w")).alias(k) for k in metrics.MOMENTS])
    assert {r["method"]: r["rmse"] for r in sums.select("method", metrics.from_moments()["rmse"].alias("rmse")).collect()} == pytest.approx(direct)


def test_enrich_checks(spark):
    pairs = spark.createDataFrame([("a", "g"), ("b", "g")], "card_a string, group_b string")
    est = spark.createDataFrame([("m", "a", "g", 1.0), ("m", "b", "g", 2.0)], "method string, card_a string, group_b string, value double")
    assert metrics.enrich(pairs, est).count() == 2
    with pytest.raises(ValueError):
        metrics.enrich(pairs, est.unionAll(est))
    with pytest.raises(ValueError):
        metrics.enrich(pairs, est.limit(1))


def test_learners_recover():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 4))
    t = (rng.random(3000) < learners.sigmoid(x[:, 0])).astype(float)
    assert np.corrcoef(learners.Logit().fit(x, t).predict(x), x[:, 0])[0, 1] > 0.95
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + x[:, 1]
    for model in (learners.Boosted(60, 0.2, 3, 20, binary=False), learners.Forest(20, 6, 10)):
        assert np.mean((model.fit(x, y).predict(x) - y) ** 2) < 0.25 * y.var()
    net = learners.ThreeHeads(epochs=40).fit(x, t, np.column_stack([2 * t + x[:, 1], x[:, 2]]))
    _, m0, m1 = net.predict(x[t == 1])
    assert net.useful and (m1 - m0)[:, 0].mean() == pytest.approx(2, abs=0.3)


def synthetic(spark, n=2400):
    rng = np.random.default_rng(2)
    cols = {c: rng.integers(0, 5, n).astype(float) for c in features.CORE}
    offered = rng.random(n) < 0.3
    t = offered & (rng.random(n) < learners.sigmoid(cols["avg_cmc"] - 2))
    y = 2 * t + cols["avg_cmc"] + 0.5 * cols["n_rares"] + rng.standard_normal(n) * 0.3
    df = pd.DataFrame({"card_a": "k", "draft_id": np.arange(n), "T": t.astype(int), "not_offered": (~offered).astype(int), "Y_g": y, **cols})
    return spark.createDataFrame(df)


def test_estimators_recover_the_effect(spark):
    frame = synthetic(spark)
    found = {r["method"]: r["value"] for r in models.estimate(frame, ["g"], ["sipw_logit", "sipw_gbm", "match_ps_logit_k3", "dm_impute_t_att_gbm", "dr_att_gbm", "cf_att"]).collect()}
    found |= {r["method"]: r["value"] for r in ridge_imputation(frame, ["g"]).collect()}
    assert all(v == pytest.approx(2, abs=0.35) for v in found.values()), found
    assert found["dm_impute_t_att_lin"] == pytest.approx(2, abs=0.05)
    with pytest.raises(ValueError):
        models.chosen(["nobody"])


def test_ridge_equals_least_squares(spark):
    frame = synthetic(spark, 500)
    pdf = frame.toPandas()
    c, t = pdf[pdf["T"] == 0], pdf[pdf["T"] == 1]
    design = lambda d: np.column_stack([np.ones(len(d)), d[list(features.CORE)]])
    beta = np.linalg.lstsq(design(c), c["Y_g"], rcond=None)[0]
    assert ridge_imputation(frame, ["g"]).first()["value"] == pytest.approx((t["Y_g"] - design(t) @ beta).mean())


def test_nearest_breaks_ties_by_place():
    pool = np.array([[1.0], [0.0], [1.0], [3.0]])
    assert nearest(np.array([[1.0]]), pool, 3).tolist() == [[0, 2, 1]]
    assert scaled(np.array([[1.0, 5.0], [3.0, 5.0]])).tolist() == [[-1.0, 0.0], [1.0, 0.0]]


def test_cards_without_treated_rows(spark):
    frame = synthetic(spark, 100).withColumn("T", F.lit(0))
    assert models.estimate(frame, ["g"], ["sipw_logit"]).first()["value"] is None
    assert per_card(frame.limit(0), [], lambda p: []).count() == 0


def test_stream_of_statistics(spark, x, tmp_path):
    even, odd = (x.picks.where(F.col("draft_id") % 2 == i) for i in (0, 1))
    for i, part in enumerate((even, odd)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    stream = spark.readStream.schema(x.picks.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    merge_batches(stream, x.cards, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    key = lambda df: sorted((r["card_a"], r["group_b"], r["z"], r["n"], r["sum_d"], r["sum_y"], r["sum_y_sq"], r["sum_dy"]) for r in df.collect())
    assert key(merged(spark, f"{tmp_path}/out")) == key(iv.sufficient_stats(x))


def test_offers_of_a_pack(spark):
    picks = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 2, "a")], "draft_id long, pack int, pick_no int, card string")
    assert {r["card"]: (r["n_first"], r["n_rows"]) for r in pack_offers(picks).collect()} == {"a": (2, 3), "b": (1, 2)}
    assert Facts(picks, picks, picks).picks is picks


def test_report(spark):
    rows = scoring_rows(spark)
    text = scores_table(metrics.method_scores(rows), resample.bootstrap_intervals(rows, n_boot=20))
    assert "zero" in text and r"$\pm$" in text and cell(None) == "--" and cell(0.5, 0.25) == r"50.00 $\pm$ 25.00"


def test_rank_separation_rejects_bad_steps(spark):
    with pytest.raises(ValueError):
        resample.rank_separation(scoring_rows(spark).where("method = 'm'"), r=0.6)


def test_histogram_and_profiles(spark, x, tmp_path):
    from tallyforge.sources import sinks

    text = sinks.histogram_json(facts.pack_length_hist(x.picks))
    assert list(sinks.read_histogram(text)) == sorted(sinks.read_histogram(text))
    sinks.save_profiles({"logit": {"c": 1.0}}, str(tmp_path / "p.json"))
    assert sinks.load_profiles(str(tmp_path / "p.json"), models.PROFILES)["logit"] == {"c": 1.0}
    with pytest.raises(ValueError):
        sinks.load_profiles(str(tmp_path / "p.json"), {"forest": {}})


def test_grids_and_views():
    space = {"a": [1, 2], "b": [3, 4, 5]}
    assert [models.decode_grid(i, space) for i in (0, 1, 5)] == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 5}]
    assert len({tuple(p.items()) for p in models.random_grid(space, 4)}) == 4 and len(models.random_grid(space, 99)) == 6
    assert features.core_view([*features.CORE, "x"]) == list(features.CORE) and features.core_view(["x"]) == ["x"]
    with pytest.raises(KeyError):
        features.core_view(["oncolor_pip_share"])


def test_model_reports(spark):
    frame = synthetic(spark, 900)
    report = {r["figure"]: r["value"] for r in models.net_report(frame, ["g"]).collect()}
    assert report["n_rows"] == 900 and report["fitted"] == 1 and report["epochs_run"] >= report["best_epoch"] >= 1 and len(report) == 17
    diag = {r["figure"]: r["value"] for r in models.forest_diagnostics(frame, "g").collect()}
    assert diag["tau_att"] == pytest.approx(2, abs=0.6) and diag["r_loss"] > 0
    assert models.tune(frame, [], {"trees": [5, 10]}).count() == 2


def test_every_control_is_read(spark):
    rng = np.random.default_rng(3)
    n = 60_000
    cols = {c: rng.integers(0, 5, n).astype(float) for c in features.CORE}
    offered, t = np.arange(n) % 3 == 0, np.arange(n) % 1500 == 0
    y = rng.standard_normal(n)
    frame = spark.createDataFrame(pd.DataFrame({"card_a": "k", "draft_id": np.arange(n), "T": t.astype(int), "not_offered": (~offered).astype(int), "Y_g": y, **cols}))
    sizes = lambda p: [("n", k, float(v)) for k, v in (("all", len(p)), ("treated", p["T"].sum()), ("offered", (p["not_offered"] == 0).sum()))]
    found = lambda df: {r["group_b"]: r["value"] for r in df.collect()}
    assert found(per_card(frame, [], sizes)) == {"all": n, "treated": t.sum(), "offered": offered.sum()}
    thin = found(per_card(frame, [], sizes, max_controls=6000))
    assert thin["treated"] == t.sum() and thin["all"] - t.sum() == pytest.approx(6000, rel=0.1) and thin["offered"] - t.sum() == pytest.approx(2000, rel=0.1)
    z = scaled(np.column_stack([cols[c] for c in features.CORE]))
    at = [np.argsort(((p - z[~t]) ** 2).sum(axis=1).round(9), kind="stable")[:3] for p in z[t]]
    expected = np.mean([v - y[~t][i].mean() for v, i in zip(y[t], at, strict=True)])
    assert match_cov(frame, ["g"]).first()["value"] == pytest.approx(expected, abs=1e-9)


def test_nearest_in_blocks_equals_a_whole_sort():
    rng = np.random.default_rng(4)
    points, pool = rng.integers(0, 4, (50, 3)) / 3, rng.integers(0, 4, (900, 3)) / 3
    d = ((points[:, None, :] - pool[None, :, :]) ** 2).sum(axis=2).round(9)
    assert (nearest(points, pool, 5, block=7, pool_block=11) == np.argsort(d, axis=1, kind="stable")[:, :5]).all()


def test_forest_diagnostics_of_all_groups(spark):
    frame = synthetic(spark, 900).withColumn("Y_h", F.col("Y_g") - 2 * F.col("T"))
    rows = models.forest_diagnostics(frame, ["g", "h"])
    assert rows.columns == ["card_a", "group_b", "figure", "value"]
    found = {(r["group_b"], r["figure"]): r["value"] for r in rows.collect()}
    assert len(found) == 14 and found["g", "tau_att"] == pytest.approx(2, abs=0.6) and found["h", "tau_att"] == pytest.approx(0, abs=0.6)
    assert found["g", "t_share"] == found["h", "t_share"]


def test_registered_bootstraps_have_all_draws(spark):
    used = [r["n_boot_used"] for r in queries.QUERIES["bootstrap_intervals"](spark, SF).collect()]
    assert max(used) >= 1000
    found = [r["p"] for r in queries.QUERIES["significance_matrix"](spark, SF).collect() if r["p"] is not None]
    # One of six pairs can be significant alone.
    assert found and min(found) < 0.05 / 6


def test_buckets_of_sets_of_colors_equal_those_of_rows(x):
    groups = features.groups_of(x)
    key = lambda b: sorted(map(str, exclusion.matched_contrast(b, groups).withColumn("z", F.round("smd", 9)).drop("smd", "abs_smd", "mean_diff", "pooled_sd", "mean_y_z1", "mean_y_z0", "var_y_z1", "var_y_z0", "sd_y_z1", "sd_y_z0").orderBy("card_a", "group_b").collect()))
    assert key(exclusion.sparse_buckets(x, groups)) == key(exclusion.dense_buckets(features.frame(x, groups), groups))


def test_t_interval(spark):
    assert [round(stats.t_quantile(0.975, n), 4) for n in (1, 2, 10, 100)] == [12.7062, 4.3027, 2.2281, 1.984]
    rows = spark.createDataFrame([(float(i), float(i * i)) for i in range(20)], "x double, y double")
    out = metrics.value_per_quanta(rows, "x", "y", bins=2, level=0.95, last=True).collect()
    assert [r["n"] for r in out] == [10, 10] and out[0]["half_y"] == pytest.approx(stats.t_quantile(0.975, 9) * out[0]["sem_y"])
    even = metrics.value_per_quanta(rows, "x", "y", bins=4, quantile=False, last=True).collect()
    assert sum(r["n"] for r in even) == 20


@pytest.mark.parametrize(("profile", "space"), [("logit", {"c": [0.01, 1.0]}), ("gbm_y", {"trees": [1, 30]}), ("forest", {"trees": [4], "leaf": [20, 300]})])
def test_tuning_takes_the_least_pooled_loss(spark, profile, space):
    frame = synthetic(spark, 900)
    two = frame.unionByName(frame.withColumn("card_a", F.lit("other")))
    rows = models.tune(two, ["g"], space, profile=profile).collect()
    assert len(rows) == 2 and [r["best"] for r in rows].count(True) == 1 and {r["n_cards"] for r in rows} == {2}
    assert min(rows, key=lambda r: r["loss"])["best"] and all(r["n_rows"] > 0 for r in rows)
    one = {r["point"]: r for r in models.tune(frame, ["g"], space, profile=profile).collect()}
    assert all(r["n_rows"] > one[r["point"]]["n_rows"] for r in rows)
    if profile == "gbm_y":
        assert next(r for r in rows if r["best"])["point"] == 1
    with pytest.raises(ValueError):
        models.tuned(frame, ["g"], "none", [{}])


def test_sweep_within_sets(spark):
    rows = scoring_rows(spark)
    both = rows.withColumn("set_code", F.lit("A")).unionByName(rows.withColumn("set_code", F.lit("B")))
    out = resample.rsc_sensitivity(both, (0.2,), fixed=0.1, n_boot=50, by="set_code").first()
    assert out["remaining"] == resample.rsc_sensitivity(rows, (0.2,), fixed=0.1, n_boot=50).first()["remaining"]


def test_net_recovers_an_effect():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 8))
    t = (rng.random(4000) < 1 / (1 + np.exp(1 - x[:, 0]))).astype(float)
    y = 2 * t + x @ rng.standard_normal(8) + 0.5 * rng.standard_normal(4000)
    net = learners.ThreeHeads().fit(x, t, np.column_stack([y, -y]))
    _, m0, m1 = net.predict(x[t == 1])
    assert (y[t == 1] - m0[:, 0]).mean() == pytest.approx(2, abs=0.2) and (m1 - m0).mean(axis=0).tolist() == pytest.approx([2, -2], abs=0.2)
    told = net.report()
    assert told["useful"] and told["best_epoch"] <= told["epochs_run"] <= 200 and told["lr_final"] == pytest.approx(1e-3 / 2 ** told["n_lr_drops"])


def test_stored_results(spark, tmp_path):
    from tallyforge.sources import sinks

    built = []
    build = lambda: built.append(1) or spark.range(3)
    assert [drafts.build_or_read(spark, f"{tmp_path}/t", build).count() for _ in range(2)] == [3, 3] and len(built) == 1
    rows = spark.createDataFrame([("m", "Card, A", "g", 1.5), ("m", "B", "g", None), ("n", "B", "g", 2.0)], "method string, card_a string, group_b string, value double")
    drafts.write_estimates(rows, f"{tmp_path}/e")
    assert drafts.read_estimates(spark, f"{tmp_path}/e").count() == 3
    rows.where("method = 'n'").write.mode("append").partitionBy("method", "card_a").parquet(f"{tmp_path}/e")
    with pytest.raises(ValueError):
        drafts.read_estimates(spark, f"{tmp_path}/e")
    sinks.write_csv(rows, f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True).where("card_a = 'Card, A'").first()["value"] == "1.5"
    assert drafts.shard_name("satt", "ABC", "Card, A") == f"satt.ABC.{zlib.crc32(b'Card, A'):08x}.csv"


def test_tables_of_ranks_and_sweeps(spark):
    rho = spark.createDataFrame([("rmse", "a", "b", 0.5), ("mae", "a", "b", None)], "metric string, variant_a string, variant_b string, rho double")
    text = spearman_table(rho)
    assert "rmse & a & b & 0.50" in text and "mae & a & b & --" in text
    sweep = spark.createDataFrame([(0.4, 0.25, 1.0, None, 0.5, 0.1), (0.2, 0.5, 1.0, 1.0, 1.0, 1.0)], "value double, remaining double, rmse double, mae double, ccc double, accuracy95 double")
    lines = sensitivity_table(sweep).splitlines()
    assert lines[4].startswith("0.2 & 50.00") and lines[5].startswith("0.4 & 25.00 & 1.00 & --")


def test_tails(spark):
    zs = spark.createDataFrame([(0.0,), (1.0,), (2.5,), (6.0,)], "z double")
    for z, exact, near in zs.select("z", stats.exact_upper_tail(F.col("z")), stats.upper_tail(F.col("z"))).collect():
        assert exact == pytest.approx(0.5 * math.erfc(z / math.sqrt(2))) and near == pytest.approx(exact, abs=2e-7)
