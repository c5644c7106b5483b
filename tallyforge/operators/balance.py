"""Balance of the instrument: group counts of the history pack by offered and not offered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..sources.tables import Facts
from .facts import drafts
from .iv import arm_sums


def balance(facts: Facts) -> DataFrame:
    """Standardised mean differences by card and group; null where they are undefined."""
    a = arm_sums(facts, 0)
    less = lambda x: F.col(f"{x}_all") - F.col(f"{x}_h") - F.col(f"{x}_o")
    arms = {"z1": (F.col("n_o"), F.col("s_o"), F.col("q_o")), "z0": (less("n"), less("s"), less("q"))}
    cols = {}
    for arm, (n, s, q) in arms.items():
        mean = ratio(s, n)
        cols[f"n_{arm}"], cols[f"mean_x_{arm}"] = n, mean
        cols[f"var_x_{arm}"] = F.when(n >= 2, ratio(F.greatest(F.lit(0.0), q - n * mean * mean), n - 1))
    out = a.select("card_a", "group_b", *[c.alias(k) for k, c in cols.items()], (F.col("n_all") - F.col("n_h")).alias("n_valid"), F.col("n_h").alias("n_invalid"), F.col("n_o").alias("n_offered"))
    out = out.withColumn("sd_x_z1", F.sqrt("var_x_z1")).withColumn("sd_x_z0", F.sqrt("var_x_z0"))
    out = out.withColumn("mean_diff", F.col("mean_x_z1") - F.col("mean_x_z0")).withColumn("pooled_sd", F.sqrt((F.col("var_x_z1") + F.col("var_x_z0")) / 2))
    out = out.withColumn("smd", F.col("mean_diff") / F.nullif("pooled_sd", F.lit(0.0)))
    incomplete = drafts(facts).where("reached").agg(F.count_if(~F.col("complete")).alias("n_incomplete"))
    return out.withColumn("abs_smd", F.abs("smd")).crossJoin(F.broadcast(incomplete))


def smd_quantiles(table: DataFrame, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles of the absolute differences, over all pairs."""
    return table.agg(*[F.percentile("abs_smd", p).alias(f"q{round(100 * p)}") for p in points], F.count("abs_smd").alias("n"))


def card_quantiles(table: DataFrame) -> DataFrame:
    """Per card mean, median, q95, max and number; then the medians of these over cards."""
    cards = table.groupBy("card_a").agg(F.avg("abs_smd").alias("mean"), F.percentile("abs_smd", 0.5).alias("median"), F.percentile("abs_smd", 0.95).alias("q95"), F.max("abs_smd").alias("max"), F.count("abs_smd").alias("n"))
    return cards.agg(*[F.percentile(c, 0.5).alias(f"median_{c}") for c in ("mean", "median", "q95", "max")], F.sum("n").alias("n"))
