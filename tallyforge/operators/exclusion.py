"""Exclusion diagnostic: offered but untaken drafts against unoffered ones with equal covariates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cards import COLORS
from ..functions.stats import ratio
from ..sources.store import stored
from ..sources.tables import Facts
from .facts import arms
from .features import CORE, card_colors, per_draft, relative


def dense_buckets(frame: DataFrame, groups: list[str], core: tuple[str, ...] = CORE) -> DataFrame:
    """Per card and bucket (equal covariates) the untreated rows of a frame, offered (1) and not (0)."""
    rows = frame.where("T = 0").fillna(0.0, list(core))
    sums = [F.sum(F.when(F.col("not_offered") == z, F.col(f"Y_{g}"))).alias(f"{name}_{g}") for z, name in ((0, "s1"), (1, "s0")) for g in groups]
    squares = [F.sum(F.when(F.col("not_offered") == 0, F.col(f"Y_{g}") * F.col(f"Y_{g}"))).alias(f"q1_{g}") for g in groups]
    return rows.groupBy("card_a", *core).agg(F.count_if(F.col("not_offered") == 0).alias("n1"), F.count_if(F.col("not_offered") == 1).alias("n0"), *sums, *squares)


def sparse_buckets(facts: Facts, groups: list[str], core: tuple[str, ...] = CORE) -> DataFrame:
    """The same buckets without a row for each draft and card.

    Covariates depend on a card's colors only, so drafts are put into buckets once for each set
    of colors. What a card held or was offered is put into buckets by itself; the rest of a
    bucket was not offered. Of buckets without an offered row only the number of drafts matters;
    a card has these in one row without covariates.
    """
    flags, own = [f"on_{c}" for c in COLORS], per_draft(facts, groups)
    sets = card_colors(facts)
    total = relative(own.crossJoin(F.broadcast(sets.select(*flags).distinct()))).fillna(0.0, list(core))
    total = total.groupBy(*flags, *core).agg(F.count("*").alias("n_all"), *[F.sum(f"Y_{g}").alias(f"all_{g}") for g in groups])
    marked = arms(facts).withColumnRenamed("card", "card_a").join(F.broadcast(sets), "card_a").join(own, "draft_id")
    untaken = F.col("arm").isin("s0", "m0")
    sums = [e for g in groups for e in (F.sum(F.when(untaken, F.col(f"Y_{g}"))).alias(f"s1_{g}"), F.sum(F.when(untaken, F.col(f"Y_{g}") * F.col(f"Y_{g}"))).alias(f"q1_{g}"), F.sum(f"Y_{g}").alias(f"out_{g}"))]
    marked = relative(marked).fillna(0.0, list(core)).groupBy("card_a", *flags, *core).agg(F.count_if(untaken).alias("n1"), F.count("*").alias("n_out"), *sums)
    # Both are read twice; so each is aggregated and shuffled once.
    marked = stored(marked, "marked")
    met = marked.where("n1 > 0").join(total, [*flags, *core])
    met = met.select("card_a", *core, "n1", (F.col("n_all") - F.col("n_out")).alias("n0"), *[c for g in groups for c in (f"s1_{g}", (F.col(f"all_{g}") - F.col(f"out_{g}")).alias(f"s0_{g}"), f"q1_{g}")])
    met = stored(met, "met")
    # One row a card for what no bucket above holds: all valid drafts less the card's own less those in the buckets.
    inside = met.groupBy("card_a").agg(F.sum("n0").alias("met"))
    outside = marked.groupBy("card_a").agg(F.sum("n_out").alias("n_out"))
    rest = sets.select("card_a").join(outside, "card_a", "left").join(inside, "card_a", "left").crossJoin(F.broadcast(own.agg(F.count("*").alias("n")))).fillna(0)
    rest = rest.select("card_a", F.lit(0).cast("long").alias("n1"), (F.col("n") - F.col("n_out") - F.col("met")).alias("n0")).where("n0 > 0")
    return met.unionByName(rest, allowMissingColumns=True)


def matched_contrast(buckets: DataFrame, groups: list[str], core: tuple[str, ...] = CORE) -> DataFrame:
    """Per card and group the exact-match contrast within untreated rows, from their buckets."""
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    values = F.explode(F.array(*[F.struct(F.lit(g).alias("group_b"), F.col(f"s1_{g}").alias("s1"), F.col(f"q1_{g}").alias("q1"), (F.col(f"s0_{g}") / F.nullif("n0", F.lit(0))).alias("m0")) for g in groups]))
    long = buckets.select("card_a", "n1", "n0", both.alias("both"), values.alias("v")).select("card_a", "n1", "n0", "both", "v.*")
    when = lambda c: F.coalesce(F.sum(F.when(F.col("both"), c)), F.lit(0))
    out = long.groupBy("card_a", "group_b").agg(F.sum("n1").alias("n_z1t0"), when(F.col("n1")).alias("n_matched"), F.sum("n0").alias("n_z0_pool"), when(F.col("n0")).alias("n_z0_used"), F.count_if("both").alias("n_buckets"), when(F.col("s1")).alias("s1"), when(F.col("q1")).alias("q1"), when(F.col("n1") * F.col("m0")).alias("s0"), when(F.col("n1") * F.col("m0") * F.col("m0")).alias("q0"))
    n = F.col("n_matched")
    enough = n >= 2
    mean1, mean0 = F.when(enough, ratio(F.col("s1"), n)), F.when(enough, ratio(F.col("s0"), n))
    var = lambda q, s: F.when(enough, ratio(F.greatest(F.lit(0.0), F.col(q) - F.col(s) * F.col(s) / F.nullif(n, F.lit(0))), n - 1))
    out = out.select("card_a", "group_b", F.lit(len(core)).alias("n_covariates"), "n_z1t0", "n_matched", (1 - ratio(n, F.col("n_z1t0"))).alias("drop_ratio"), "n_z0_pool", "n_z0_used", "n_buckets", ratio(F.col("n_z0_used"), F.col("n_buckets")).alias("mean_bucket"), mean1.alias("mean_y_z1"), mean0.alias("mean_y_z0"), var("q1", "s1").alias("var_y_z1"), var("q0", "s0").alias("var_y_z0"))
    out = out.withColumn("sd_y_z1", F.sqrt("var_y_z1")).withColumn("sd_y_z0", F.sqrt("var_y_z0")).withColumn("mean_diff", F.col("mean_y_z1") - F.col("mean_y_z0"))
    out = out.withColumn("pooled_sd", F.sqrt((F.col("var_y_z1") + F.col("var_y_z0")) / 2)).withColumn("smd", F.col("mean_diff") / F.nullif("pooled_sd", F.lit(0.0)))
    return out.withColumn("abs_smd", F.abs("smd"))


def drop_summary(table: DataFrame, most: float = 0.5) -> DataFrame:
    """One row: pairs, the share of them that keeps enough of its offered rows, and quantiles of the absolute differences."""
    points = [F.percentile("abs_smd", p).alias(f"q{round(100 * p)}") for p in (0.5, 0.95)]
    return table.agg(F.count("*").alias("n_pairs"), F.avg((F.col("drop_ratio") < most).cast("double")).alias("share_kept"), *points)
