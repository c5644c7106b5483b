"""Instrumental-variable reference effects from sparse sufficient statistics.

All sums are integers, so the arm that was offered nothing follows exactly as all drafts less
holders less offered ones; drafts are never crossed with cards and groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, upper_tail
from ..sources.tables import Facts
from .facts import ASSIGNMENT, OUTCOME, arm_table, draft_accounting


def arm_sums(facts: Facts, pack: int) -> DataFrame:
    """card_a, group_b with n, s (sum), q (sum of squares) for all, held and singly offered drafts, and d, sd of the treated."""
    both = lambda x: (F.col(f"{x}_s1") + F.col(f"{x}_s0")).alias(f"{x}_o")
    return arm_table(facts, pack).select(
        "card_a", "group_b", "n_h", "s_h", "q_h", *map(both, "nsq"), F.col("n_s1").alias("d_o"), F.col("s_s1").alias("sd_o"), "n_all", "s_all", "q_all"
    )


def sufficient_stats(facts: Facts) -> DataFrame:
    """card_a, group_b, z with n, sum_d, sum_y, sum_y_sq, sum_dy."""
    a = arm_sums(facts, OUTCOME)
    zero = F.lit(0).cast("long")
    one = F.struct(F.lit(1).alias("z"), F.col("n_o").alias("n"), F.col("d_o").alias("sum_d"), F.col("s_o").alias("sum_y"), F.col("q_o").alias("sum_y_sq"), F.col("sd_o").alias("sum_dy"))
    less = lambda x: F.col(f"{x}_all") - F.col(f"{x}_h") - F.col(f"{x}_o")
    none = F.struct(F.lit(0).alias("z"), less("n").alias("n"), zero.alias("sum_d"), less("s").alias("sum_y"), less("q").alias("sum_y_sq"), zero.alias("sum_dy"))
    return a.select("card_a", "group_b", F.explode(F.array(one, none)).alias("x")).select("card_a", "group_b", "x.*")


def wald(n1: Column, d1: Column, y1: Column, q1: Column, dy1: Column, n0: Column, y0: Column, q0: Column) -> dict[str, Column]:
    """Wald ratio and delta-method standard error from integer sums; nobody is treated in arm 0."""
    my1, my0, md1 = ratio(y1, n1), ratio(y0, n0), ratio(d1, n1)
    itt_y, itt_d = my1 - my0, md1
    var_y = ratio(q1 - n1 * my1 * my1, (n1 - 1) * n1) + ratio(q0 - n0 * my0 * my0, (n0 - 1) * n0)
    var_d = ratio(md1 * (1 - md1), n1)
    cov = ratio(dy1 - n1 * my1 * md1, (n1 - 1) * n1)
    safe = F.nullif(itt_d, F.lit(0.0))
    variance = var_y / (safe * safe) + itt_y * itt_y * var_d / F.pow(safe, 4) - 2 * itt_y * cov / F.pow(safe, 3)
    return {"itt_y": itt_y, "itt_d": itt_d, "late": itt_y / safe, "se_late": F.sqrt(F.greatest(F.lit(0.0), variance))}


def reference_effects(facts: Facts) -> DataFrame:
    """One row per card and group: effect, error, z, p and the card's accounting."""
    a = arm_sums(facts, OUTCOME)
    less = lambda x: F.col(f"{x}_all") - F.col(f"{x}_h") - F.col(f"{x}_o")
    est = wald(F.col("n_o"), F.col("d_o"), F.col("s_o"), F.col("q_o"), F.col("sd_o"), less("n"), less("s"), less("q"))
    kept = a.where((F.col("n_o") >= 2) & (less("n") >= 2) & (F.col("d_o") > 0)).select("card_a", "group_b", F.lit(ASSIGNMENT).alias("pack"), *[c.alias(k) for k, c in est.items()])
    z = F.when(F.col("se_late") > 0, F.col("late") / F.nullif("se_late", F.lit(0.0))).otherwise(0.0)
    kept = kept.withColumn("z_stat", z).withColumn("p_value", 2 * upper_tail(F.abs("z_stat")))
    return kept.join(F.broadcast(draft_accounting(facts)), "card_a")
