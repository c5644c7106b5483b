"""Estimators by boosted propensities and outcomes, as sums over weighted cells.

The propensity is fitted on the offered core cells, the control outcomes of all groups on the control cells with
all covariates; its trees then score the treated cells and, for the doubly robust estimator alone, the controls again.
Only that one needs both fits, which run beside each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..sources.store import stored
from .boosting import Boosting, beside, boosted, residuals, scorer
from .cells import CLIP, LEAST, Cells, all_pairs, parameters, sizes
from .neighbours import SCORE_DIGITS, match_scored


@dataclass
class Propensity:
    """The cards that can be fitted, and a function that adds ``e``, the chance of treatment, to rows of these cards."""

    cards: list[str]
    score: Callable[[DataFrame], DataFrame]


def of_cards(rows: DataFrame, cards: list[str]) -> DataFrame:
    return rows.where(F.col("card_a").isin(*cards)) if cards else rows.limit(0)


def fitting(cells: Cells) -> dict[str, dict[str, int]]:
    """``sizes`` of the cards that can be fitted."""
    return {card: v for card, v in sizes(cells).items() if v["t"] >= LEAST and v["o"] >= LEAST}


def propensity(cells: Cells, settings: dict) -> Propensity:
    """Fitted on offered cells, times the card's share of offered drafts; for cards with ``LEAST`` treated and offered controls."""
    n = fitting(cells)
    offered = cells.own.where("n_t + n_o > 0").groupBy("card_a", *cells.names).agg(F.sum(F.col("n_t") + F.col("n_o")).alias("n"), F.sum("n_t").alias("s_T"))
    fit = boosted(stored(of_cards(offered, list(n)), "offered"), cells.names, ["T"], settings, binary=True, keep=True)
    add = scorer(fit, "_p")
    shares = {card: {"share": [(v["t"] + v["o"]) / v["n"]]} for card, v in n.items()} or {"": {"share": []}}
    return Propensity(list(n), lambda rows: add(rows).join(parameters(cells, shares).drop("pool"), "card_a").withColumn("e", F.get("share", 0) * F.col("_p")).drop("_p", "share"))


def odds(rows: DataFrame) -> DataFrame:
    e = F.least(F.col("e"), F.lit(min(1 - CLIP, 1 - 1e-6)))
    return rows.withColumn("w", e / (1 - e)).drop("e")


def controls(cells: Cells, cards: list[str]) -> DataFrame:
    """card_a, covariates, n, ``s_<group>``: the controls of some cards by cell, the pool's less the card's own held or treated; stored."""
    sums = ["n", *[f"s_{g}" for g in cells.groups]]
    pool = F.broadcast(of_cards(cells.cards, cards)).join(cells.pool, "pool").select("card_a", *cells.names, *sums)
    less = [(-F.col("n_t") - F.col("n_h")).alias("n"), *[(-F.col(f"t_{g}") - F.col(f"h_{g}")).alias(f"s_{g}") for g in cells.groups]]
    own = of_cards(cells.own, cards).where("n_t + n_h > 0").select("card_a", *cells.names, *less)
    return stored(pool.unionByName(own).groupBy("card_a", *cells.names).agg(*[F.sum(c).alias(c) for c in sums]).where("n > 0"), "controls")


def by_group(cells: Cells, sums: DataFrame, value: Callable[[str], Column], method: str) -> DataFrame:
    """method, card_a, group_b, value of all pairs from one row a card; null where there is none."""
    values = F.explode(F.array(*[F.struct(F.lit(g).alias("group_b"), value(g).alias("value")) for g in cells.groups]))
    found = sums.select("card_a", values.alias("v")).select("card_a", "v.*")
    return all_pairs(cells, method).join(found, ["card_a", "group_b"], "left").select("method", "card_a", "group_b", "value")


def sipw(cells: Cells, e: Propensity) -> DataFrame:
    """Mean outcome of the treated less the mean of controls weighted by their odds."""
    w = odds(e.score(controls(cells, e.cards)))
    against = w.groupBy("card_a").agg(F.sum(F.col("w") * F.col("n")).alias("m"), *[F.sum(F.col("w") * F.col(f"s_{g}")).alias(f"c_{g}") for g in cells.groups])
    treated = cells.own.groupBy("card_a").agg(F.sum("n_t").alias("n_t"), *[F.sum(f"t_{g}").alias(f"t_{g}") for g in cells.groups])
    return by_group(cells, against.join(treated, "card_a"), lambda g: ratio(F.col(f"t_{g}"), F.col("n_t")) - ratio(F.col(f"c_{g}"), F.col("m")), "sipw_gbm")


def match(cells: Cells, e: Propensity, k: int = 3) -> DataFrame:
    """Each treated draft against its ``k`` nearest controls by boosted propensity, compared to ``SCORE_DIGITS``."""
    whole = lambda rows: e.score(rows).withColumn("e", F.round(F.col("e") * F.lit(10.0**SCORE_DIGITS)).cast("long"))
    return match_scored(cells, whole, e.cards, k, "match_ps_gbm_k3")


@dataclass
class Outcomes:
    """A fit of the control outcomes of all groups: the control cells it was made on, its trees."""

    cells: Cells
    rows: DataFrame
    fit: Boosting


def outcomes(cells: Cells, settings: dict) -> Outcomes:
    rows = controls(cells, list(fitting(cells)))
    return Outcomes(cells, rows, boosted(rows, cells.names, cells.groups, settings, keep=True))


def treated_residuals(of: Outcomes) -> DataFrame:
    """By card and group the number of treated drafts (``mass``) and the sum of outcome less fitted control outcome (``rest``)."""
    x = of.cells
    rows = of_cards(x.own, list(of.fit.edges)).where("n_t > 0").groupBy("card_a", *x.names).agg(F.sum("n_t").alias("n"), *[F.sum(f"t_{g}").alias(f"s_{g}") for g in x.groups])
    return residuals(of.fit, rows.withColumn("w", F.lit(1.0)), x.groups)


def control_residuals(of: Outcomes, e: Propensity) -> DataFrame:
    """The same of the controls, weighted by their odds."""
    return residuals(of.fit, odds(e.score(of.rows)), of.cells.groups)


def imputed(of: Outcomes, e: Propensity | None = None) -> DataFrame:
    """Mean residual of the treated, less the weighted one of the controls if there is a propensity."""
    mean = ratio(F.col("rest"), F.col("mass"))
    found = treated_residuals(of).select("card_a", "group_b", mean.alias("value"))
    if e is not None:
        found = found.join(control_residuals(of, e).select("card_a", "group_b", mean.alias("less")), ["card_a", "group_b"], "left").select("card_a", "group_b", (F.col("value") - F.col("less")).alias("value"))
    return all_pairs(of.cells, "dm_impute_t_att_gbm" if e is None else "dr_att_gbm").join(found, ["card_a", "group_b"], "left").select("method", "card_a", "group_b", "value")


#: Those of the outcomes' fit, and which of them need the propensity.
OUTCOMES = {"dm_impute_t_att_gbm": False, "dr_att_gbm": True}
PROPENSITIES = {"sipw_gbm": sipw, "match_ps_gbm_k3": match}


def estimates(core: Cells, full: Callable[[], Cells], names: list[str], profiles: dict[str, dict]) -> DataFrame:
    """method, card_a, group_b, value. ``core`` has the core covariates, ``full`` makes cells with all of them."""
    wanted = [n for n in names if n in OUTCOMES]
    cells, e, of = full() if wanted else None, None, None
    weighted = lambda: propensity(core, profiles["gbm_t"])
    imputing = lambda: outcomes(cells, profiles["gbm_y"])
    if all(n in OUTCOMES and not OUTCOMES[n] for n in names):
        of = imputing()
    elif wanted:
        e, of = beside(core.pool.sparkSession, weighted, imputing)
    else:
        e = weighted()
    parts = [PROPENSITIES[n](core, e) for n in names if n in PROPENSITIES]
    parts += [imputed(of, e if OUTCOMES[n] else None) for n in wanted]
    return reduce(DataFrame.unionByName, parts)
