"""Merged state of sources against one pass over all of them."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import facts, iv, metrics, state
from tallyforge.sources import manifest
from tallyforge.sources.tables import Facts, order_facts


@pytest.fixture(scope="module")
def x(spark):
    return order_facts(spark, "/root/testdata/sf0.001")


def part(x, condition):
    return Facts(x.picks.where(condition), x.offers.where(condition), x.cards)


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))) for r in df.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_any_split_gives_one_pass(spark, x, tmp_path, seed):
    rng, path = random.Random(seed), str(tmp_path)
    mod = rng.choice([2, 3])
    for i in rng.sample(range(mod + 1), mod + 1):  # the last source has no drafts
        state.put(part(x, (F.col("draft_id") % mod == i)), path, f"log {i}/a=%")
    merged = state.merge(spark, path)
    assert rows(state.effects(merged)) == rows(iv.reference_effects(x))
    assert rows(state.accounting(merged)) == rows(facts.draft_accounting(x))


def test_replace_and_remove(spark, x, tmp_path):
    path = str(tmp_path)
    even, odd = part(x, "draft_id % 2 = 0"), part(x, "draft_id % 2 = 1")
    state.put(odd, path, "a")
    state.put(odd, path, "b")
    state.put(even, path, "b")  # in place of the odd ones
    assert rows(state.accounting(state.merge(spark, path))) == rows(facts.draft_accounting(x))
    state.remove(spark, path, "a")
    assert rows(state.accounting(state.merge(spark, path))) == rows(facts.draft_accounting(even))
    assert rows(state.effects(state.merge(spark, path))) == rows(iv.reference_effects(even))


def test_other_cards_are_refused(spark, x, tmp_path):
    path = str(tmp_path)
    state.put(part(x, "draft_id < 50"), path, "a")
    less = part(x, "draft_id >= 50")
    state.put(Facts(less.picks, less.offers, x.cards.where("no > 3")), path, "b")
    with pytest.raises(manifest.CheckFailed):
        state.merge(spark, path)


def test_coverage_of_methods(spark):
    pairs = spark.createDataFrame([("a", "g"), ("b", "g")], "card_a string, group_b string")
    of = lambda *rows: spark.createDataFrame(list(rows), "method string, card_a string, group_b string, value double")
    assert metrics.enrich(pairs, of(("m", "a", "g", 1.0), ("m", "b", "g", None), ("m", "c", "g", 1.0))).count() == 2
    for rows_, kind in (([("m", "a", "g", 1.0), ("o", "b", "g", 1.0)], {}), ([("m", "a", "g", 1.0), ("o", "a", "g", 1.0)], {}), ([("m", "a", "g", 1.0), ("m", "b", "g", 1.0), ("m", "b", "g", 1.0)], {}), ([("m", "a", "g", 1.0), ("m", "b", "g", None)], {"require_finite": True})):
        with pytest.raises(ValueError):
            metrics.enrich(pairs, of(*rows_), **kind)
    with pytest.raises(ValueError, match="missing"):
        metrics.method_scores(of(("m", "a", "g", 1.0)))
    picks = spark.createDataFrame([(1, 0, 0, "x"), (1, 0, 1, "y"), (1, 0, 2, "k")], "draft_id long, pack int, pick_no int, card string")
    assert [tuple(r) for r in facts.unknown_picks(picks, picks.where("card = 'k'").select("card"), top=1).collect()] == [("x", 2)]
