"""Covariates: history counts per draft, columns relative to a card's colors, estimation frames."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cards import COLORS, MANA_VALUE_BUCKETS
from ..sources.tables import Facts
from .facts import OUTCOME, arms, counts_of, valid_of

COMMITTED_PIPS = 3
CORE = ("oncolor_pip_share", "oncolor_pip_min_share", "n_oncolor_pips", "offcolor_pip_share", "avg_cmc", "n_fix_oncolor", "num_colors_committed", "n_rares")
#: In a frame, but never covariates.
NOT_COVARIATES = ("draft_id", "card_a", "T", "horizon", "n_prior", "pick_number")


def history(facts: Facts, valid: DataFrame) -> DataFrame:
    """Counts over a draft's history pack; lands count apart from spells and fix their colors."""
    picks = facts.picks.where("pack = 0").join(valid, "draft_id", "left_semi").join(F.broadcast(facts.cards), "card", "left")
    known, land = F.col("mv").isNotNull(), F.coalesce(F.col("land"), F.lit(0)) == 1
    spell = known & ~land
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    aggs = [F.count("*").alias("n_prior"), F.count_if(spell).alias("n_spells"), F.count_if(known & land).alias("n_lands"), total("rare").alias("n_rares"), total("creature").alias("n_creatures"), total(F.when(spell, F.col("mv"))).alias("sum_cmc")]
    for c in COLORS:
        aggs += [total(f"is_{c}").alias(f"n_{c}"), total(f"pip_{c}").alias(f"pips_{c}"), total(F.when(land, F.col(f"is_{c}"))).alias(f"fix_{c}")]
    aggs += [F.count_if(spell & F.col("mv").between(low, high)).alias(name) for name, low, high in MANA_VALUE_BUCKETS]
    out = picks.groupBy("draft_id").agg(*aggs)
    number = lambda test: sum((F.when(test(c), 1).otherwise(0) for c in COLORS), F.lit(0))
    out = out.withColumn("num_colors", number(lambda c: F.col(f"n_{c}") > 0)).withColumn("num_colors_committed", number(lambda c: F.col(f"pips_{c}") >= COMMITTED_PIPS))
    out = out.withColumn("pips_total", sum((F.col(f"pips_{c}") for c in COLORS), F.lit(0)))
    return out.withColumn("avg_cmc", F.coalesce(F.col("sum_cmc") / F.nullif("n_spells", F.lit(0)), F.lit(0.0))).drop("sum_cmc")


def relative(joined: DataFrame) -> DataFrame:
    """Adds the columns relative to the colors (``on_<color>`` flags) of the row's card."""
    total = F.when(F.col("pips_total") > 0, F.col("pips_total")).otherwise(1)
    on = lambda c: F.col(f"on_{c}") == 1
    summed = lambda stem: sum((F.when(on(c), F.col(f"{stem}_{c}")).otherwise(0) for c in COLORS), F.lit(0))
    colors = sum((F.col(f"on_{c}") for c in COLORS), F.lit(0))
    off = F.greatest(*[F.when(~on(c), F.col(f"pips_{c}")).otherwise(0) for c in COLORS])
    low = F.when(colors > 1, F.least(*[F.when(on(c), F.col(f"pips_{c}")) for c in COLORS])).otherwise(0)
    return joined.withColumns({
        "oncolor_pip_share": summed("pips") / total,
        "oncolor_pip_min_share": low / total,
        "n_oncolor_pips": summed("pips"),
        "offcolor_pip_share": off / total,
        "n_fix_oncolor": summed("fix"),
    })


def card_colors(facts: Facts) -> DataFrame:
    """card_a and its colors' flags ``on_<color>``."""
    return facts.cards.select(F.col("card").alias("card_a"), *[F.col(f"is_{c}").alias(f"on_{c}") for c in COLORS])


def assignments(facts: Facts) -> DataFrame:
    """draft_id, card_a, T, not_offered for all valid drafts and cards not held before.

    Estimators read every such row, so this is the one place where drafts meet cards; the
    cards are broadcast metadata.
    """
    marked = arms(facts).withColumnRenamed("card", "card_a")
    every = valid_of(facts).crossJoin(F.broadcast(card_colors(facts))).join(marked, ["draft_id", "card_a"], "left").where("arm is null or arm <> 'h'")
    return every.select("draft_id", "card_a", F.coalesce(F.col("arm").endswith("1").cast("int"), F.lit(0)).alias("T"), F.col("arm").isNull().cast("int").alias("not_offered"), *[f"on_{c}" for c in COLORS])


def groups_of(facts: Facts) -> list[str]:
    """Group labels, sorted: metadata."""
    return sorted(r[0] for r in facts.cards.select("group_b").distinct().collect())


def per_draft(facts: Facts, groups: list[str]) -> DataFrame:
    """One row per valid draft: history, outcome window and outcomes ``Y_<group>``, stored."""

    def build() -> DataFrame:
        valid = valid_of(facts)
        wide = counts_of(facts, OUTCOME).groupBy("draft_id").agg(*[F.coalesce(F.sum(F.when(F.col("group_b") == g, F.col("y"))), F.lit(0)).alias(f"Y_{g}") for g in groups])
        horizon = facts.picks.where(F.col("pack") == OUTCOME).groupBy("draft_id").agg(F.count("*").alias("horizon"))
        return history(facts, valid).join(horizon, "draft_id").join(wide, "draft_id", "left").fillna(0)

    return facts.once(f"per_draft_{crc32(','.join(groups).encode())}", build)


def frame(facts: Facts, groups: list[str]) -> DataFrame:
    """The estimation frame: assignment, outcomes ``Y_<group>``, covariates, one row per draft and card."""
    return relative(assignments(facts).join(per_draft(facts, groups), "draft_id")).withColumn("pick_number", F.lit(0))


def covariates(df: DataFrame) -> list[str]:
    """Adjustment columns of a frame; the instrument is never among them."""
    return [c for c in df.columns if c not in NOT_COVARIATES and not c.startswith(("Y_", "on_", "fix_")) and c not in ("not_offered", "pips_total", "n_spells")]


def core_view(columns: list[str]) -> list[str]:
    """The core covariates in a frame's order; a frame without any relative column falls back to all it has."""
    if not any(c in columns for c in CORE[:4]):
        return list(columns)
    if missing := [c for c in CORE if c not in columns]:
        raise KeyError(f"frame lacks core covariates {missing}")
    return [c for c in columns if c in CORE]
