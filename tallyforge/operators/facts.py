"""Per-draft facts: lengths, completeness, holders, outcomes, offers, pick statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Facts

ASSIGNMENT, OUTCOME = 1, 2
ALARM = 0.05


def lengths(picks: DataFrame) -> DataFrame:
    """draft_id, p0, p1, p2, mx (longest of all packs), reached, complete."""
    packs = picks.groupBy("draft_id", "pack").agg(F.count("*").alias("n"), F.max((F.col("pick_no") == 0).cast("int")).alias("first"))
    of = lambda p: F.coalesce(F.max(F.when(F.col("pack") == p, F.col("n"))), F.lit(0))
    out = packs.groupBy("draft_id").agg(of(0).alias("p0"), of(1).alias("p1"), of(2).alias("p2"), F.max("n").alias("mx"), (F.coalesce(F.max(F.when(F.col("pack") == ASSIGNMENT, F.col("first"))), F.lit(0)) == 1).alias("reached"))
    return out.withColumn("complete", (F.col("p0") == F.col("mx")) & (F.col("p1") == F.col("mx")) & (F.col("p2") == F.col("mx")))


def valid_drafts(picks: DataFrame) -> DataFrame:
    """Ids of complete drafts that reached the assignment."""
    return lengths(picks).where("reached and complete").select("draft_id")


def drafts(facts: Facts) -> DataFrame:
    """``lengths`` of the facts, stored."""
    return facts.once("drafts", lambda: lengths(facts.picks))


def valid_of(facts: Facts) -> DataFrame:
    """``valid_drafts`` of the facts."""
    return drafts(facts).where("reached and complete").select("draft_id")


def incomplete_rate(picks: DataFrame) -> DataFrame:
    """One row: drafts that reached the assignment, incomplete ones, their share, alarm."""
    out = lengths(picks).where("reached").agg(F.count("*").alias("n_drafts"), F.count_if(~F.col("complete")).alias("n_incomplete"))
    rate = F.col("n_incomplete") / F.nullif(F.col("n_drafts"), F.lit(0))
    return out.withColumn("rate", F.coalesce(rate, F.lit(0.0))).withColumn("alarm", F.col("rate") > ALARM)


def pack_length_hist(picks: DataFrame) -> DataFrame:
    """Joint histogram of pack lengths with shares of all drafts, commonest first."""
    hist = lengths(picks).groupBy("p0", "p1", "p2").agg(F.count("*").alias("n_drafts"))
    total = hist.agg(F.sum("n_drafts").alias("total"))
    uneven = F.least("p0", "p1", "p2") != F.greatest("p0", "p1", "p2")
    # The histogram has as many rows as there are pack sizes; the total is one row.
    out = hist.crossJoin(F.broadcast(total))
    return out.select(F.concat_ws(",", "p0", "p1", "p2").alias("lengths"), "n_drafts", uneven.alias("uneven"), (F.col("n_drafts") / F.col("total")).alias("share")).orderBy(F.desc("n_drafts"), "lengths")


def holders(picks: DataFrame, valid: DataFrame) -> DataFrame:
    """Distinct (draft_id, card) held from before the assignment, in valid drafts."""
    return picks.where(F.col("pack") < ASSIGNMENT).join(valid, "draft_id", "left_semi").select("draft_id", "card").distinct()


def takers(picks: DataFrame) -> DataFrame:
    """draft_id and the card taken first in the assignment pack."""
    return picks.where((F.col("pack") == ASSIGNMENT) & (F.col("pick_no") == 0)).select("draft_id", F.col("card").alias("taken"))


def counts_by_group(picks: DataFrame, cards: DataFrame, valid: DataFrame, pack: int) -> DataFrame:
    """draft_id, group_b, y: how many cards of a group a valid draft took in a pack; no zeros."""
    window = picks.where(F.col("pack") == pack).join(F.broadcast(cards.select("card", "group_b")), "card")
    return window.join(valid, "draft_id", "left_semi").groupBy("draft_id", "group_b").agg(F.count("*").alias("y"))


def held_of(facts: Facts) -> DataFrame:
    """``holders`` of the facts, stored."""
    return facts.once("held", lambda: holders(facts.picks, valid_of(facts)))


def counts_of(facts: Facts, pack: int) -> DataFrame:
    """``counts_by_group`` of the facts in a pack, stored."""
    return facts.once(f"counts_{pack}", lambda: counts_by_group(facts.picks, facts.cards, valid_of(facts), pack))


def arms(facts: Facts) -> DataFrame:
    """draft_id, card, arm of what a valid draft held or was offered, stored.

    Arms: ``h`` held before; else offered, ``s`` as a single copy or ``m`` as several, and taken (1) or not (0).
    """

    def build() -> DataFrame:
        valid, held = valid_of(facts), held_of(facts)
        offers = facts.offers.where((F.col("pack") == ASSIGNMENT) & (F.col("n_first") > 0)).select("draft_id", "card", "n_first")
        offers = offers.join(valid, "draft_id", "left_semi").join(takers(facts.picks), "draft_id").join(held, ["draft_id", "card"], "left_anti")
        copies = F.when(F.col("n_first") == 1, "s").otherwise("m")
        arm = F.concat(copies, (F.col("taken") == F.col("card")).cast("int").cast("string"))
        return held.withColumn("arm", F.lit("h")).unionAll(offers.select("draft_id", "card", arm.alias("arm")))

    return facts.once("arms", build)


ARMS = ("h", "s1", "s0", "m1", "m0")


def arm_table(facts: Facts, pack: int) -> DataFrame:
    """Per card and group: drafts (n), sums (s) and sums of squares (q) of a pack's counts in each arm and in all, stored.

    Drafts in no arm follow as all less the arms, so drafts are never crossed with cards.
    """

    def build() -> DataFrame:
        y, marked = counts_of(facts, pack), arms(facts)
        sizes = marked.groupBy("card").agg(*[F.count_if(F.col("arm") == a).alias(f"n_{a}") for a in ARMS])
        parts = [F.coalesce(F.sum(F.when(F.col("arm") == a, x)), F.lit(0)).alias(f"{name}_{a}") for a in ARMS for name, x in (("s", F.col("y")), ("q", F.col("y") * F.col("y")))]
        sums = marked.join(y, "draft_id").groupBy("card", "group_b").agg(*parts)
        groups = y.groupBy("group_b").agg(F.sum("y").alias("s_all"), F.sum(F.col("y") * F.col("y")).alias("q_all"))
        # Cards and groups are metadata, the number of drafts is one row.
        grid = facts.cards.select("card").crossJoin(F.broadcast(facts.cards.select("group_b").distinct()))
        out = grid.join(sizes, "card", "left").join(sums, ["card", "group_b"], "left").join(groups, "group_b", "left")
        out = out.crossJoin(F.broadcast(valid_of(facts).agg(F.count("*").alias("n_all")))).fillna(0)
        return out.withColumnRenamed("card", "card_a")

    return facts.once(f"arm_table_{pack}", build)


def draft_accounting(facts: Facts) -> DataFrame:
    """Per card: valid, invalid, incomplete drafts, offers, treatments, outcome window."""
    n = drafts(facts)
    total = n.where("reached").agg(F.count_if("complete").alias("all_valid"), F.count_if(~F.col("complete")).alias("n_incomplete"), F.coalesce(F.sum(F.when(F.col("complete"), F.col("p2"))), F.lit(0)).alias("all_horizon"), F.min(F.when(F.col("complete"), F.col("p2"))).alias("lo"), F.max(F.when(F.col("complete"), F.col("p2"))).alias("hi"))
    single, taken = F.col("arm").isin("s0", "s1"), F.col("arm") == "s1"
    marked = arms(facts).join(n.select("draft_id", "p2"), "draft_id").groupBy("card")
    marked = marked.agg(F.count_if(F.col("arm") == "h").alias("n_invalid"), F.sum(F.when(F.col("arm") == "h", F.col("p2"))).alias("held_horizon"), F.count_if(single).alias("n_offered"), F.count_if(taken).alias("n_treated"))
    # All tables below have a row a card or a single row.
    out = facts.cards.select("card").join(marked, "card", "left").crossJoin(F.broadcast(total)).fillna(0, ["n_invalid", "n_offered", "n_treated", "held_horizon"])
    horizon = F.col("all_horizon") - F.col("held_horizon")
    n_valid = F.col("all_valid") - F.col("n_invalid")
    return out.select(F.col("card").alias("card_a"), n_valid.alias("n_valid"), "n_invalid", "n_incomplete", F.lit(0).cast("long").alias("n_no_outcome"), "n_offered", "n_treated", horizon.alias("horizon_total"), (horizon / F.nullif(n_valid, F.lit(0))).alias("horizon_mean"), F.col("lo").alias("horizon_min"), F.col("hi").alias("horizon_max"))


SCOPES = (("p1p1", 0), ("p2p1", 1), ("p3p1", 2))


def pick_stats(facts: Facts) -> DataFrame:
    """Per known card: times offered and picked, at the first pick of each pack and in all."""
    known = F.broadcast(facts.cards.select("card"))
    offers = facts.offers.join(known, "card").groupBy("card").agg(*[F.count_if((F.col("pack") == p) & (F.col("n_first") > 0)).alias(f"{s}_offered") for s, p in SCOPES], F.sum("n_rows").alias("total_offered"))
    picked = facts.picks.join(known, "card").groupBy("card").agg(*[F.count_if((F.col("pack") == p) & (F.col("pick_no") == 0)).alias(f"{s}_picked") for s, p in SCOPES], F.count("*").alias("total_picked"))
    out = facts.cards.select("card").join(offers, "card", "left").join(picked, "card", "left").fillna(0)
    names = [f"{s}_{k}" for s in (*(s for s, _ in SCOPES), "total") for k in ("offered", "picked")]
    return out.select(F.col("card").alias("card_name"), *names).orderBy("card_name")


def unknown_picks(picks: DataFrame, known: DataFrame, *, top: int | None = None) -> DataFrame:
    """Picks of cards without a column, summed over scopes: a first pick counts twice, as in the audit it mirrors. ``top``: only the commonest."""
    times = F.when((F.col("pick_no") == 0) & F.col("pack").between(0, 2), 2).otherwise(1)
    out = picks.join(F.broadcast(known.select("card")), "card", "left_anti").groupBy("card").agg(F.sum(times).alias("n")).orderBy(F.desc("n"), "card")
    return out if top is None else out.limit(top)


def treatment_selector(stats: DataFrame, *, least_picked: int = 500, most_ratio: float = 4.0) -> DataFrame:
    """Cards picked often enough, and in a large enough share of their offers."""
    return stats.where((F.col("p2p1_picked") > least_picked) & (F.col("p2p1_offered") < most_ratio * F.col("p2p1_picked"))).select("card_name", "p2p1_offered", "p2p1_picked")


def slot_selector(stats: DataFrame, cards: DataFrame, *, least_picked: int = 500, most_rate: float = 0.3) -> DataFrame:
    """Rare cards with a low pick rate, against every group."""
    rate = F.col("p2p1_picked") / F.nullif(F.col("p2p1_offered"), F.lit(0))
    chosen = stats.join(F.broadcast(cards.where("rare = 1").select(F.col("card").alias("card_name"))), "card_name").where((F.col("p2p1_picked") > least_picked) & (rate < most_rate))
    return chosen.select(F.col("card_name").alias("card_a"), rate.alias("pick_rate")).crossJoin(F.broadcast(cards.select("group_b").distinct()))


def split_half(draft_id, seed: int = 0):
    """Which half of the drafts one is in: 0 or 1, by hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), draft_id.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 2


#: Positions a task draws numbers for at once.
SPAN = 1 << 20


def split_in_order(drafts: DataFrame, seed: int, *, span: int = SPAN) -> DataFrame:
    """Halves from one sequential draw a draft in file order (``position`` from 0).

    Positions are dealt in spans; a task jumps to the first number of its span and draws only that span.
    """
    import pandas as pd

    from ..functions import twister

    def run(key, pdf):
        numbers = twister.draws(seed, key[0] * span, span)
        return pd.DataFrame({"draft_id": pdf["draft_id"], "half": (numbers[(pdf["position"] - key[0] * span).to_numpy()] >= 0.5).astype("int32")})

    kind = drafts.schema["draft_id"].dataType.simpleString()
    place = F.col("position").cast("long")
    return drafts.select("draft_id", place.alias("position"), F.expr(f"cast(position as bigint) div {span}").alias("span")).groupBy("span").applyInPandas(run, f"draft_id {kind}, half int")
