"""Bootstrap in relational form: counter-based draws times per-cluster moments.

A replicate never copies rows: the draws give each cluster a weight, and sums of moments
times weights give every metric. Draws depend on seed, key, replicate and slot only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import draw, upper_tail
from .fdr import benjamini_hochberg
from .metrics import METRICS, MOMENTS, ORIENTATION, centred, finite, from_moments, moment_columns, usable


def replicates(spark: SparkSession, n_boot: int) -> DataFrame:
    return spark.range(n_boot).withColumnRenamed("id", "rep")


def weights(clusters: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """cluster, rep, w from distinct ``cluster`` values: how often each is drawn."""
    indexed = clusters.select("cluster", (F.row_number().over(Window.orderBy("cluster")) - 1).alias("idx"))
    size = indexed.agg(F.count("*").alias("k"))
    slots = indexed.select("idx").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(replicates(clusters.sparkSession, n_boot)))
    drawn = slots.select("rep", draw(seed, F.col("rep"), F.col("idx"), F.col("k")).alias("idx")).groupBy("rep", "idx").agg(F.count("*").alias("w"))
    return drawn.join(indexed, "idx").select("cluster", "rep", "w")


def bootstrap_intervals(scoring: DataFrame, *, n_boot: int = 1000, ci: float = 0.95, seed: int = 0, cluster: str | None = "card_a") -> DataFrame:
    """Per method and metric: lo, hi, half width and the least number of usable replicates.

    All methods share the draws. ``cluster=None`` resamples pairs.
    """
    unit = F.col(cluster) if cluster else F.concat_ws("|", "card_a", "group_b")
    rows = centred(usable(scoring)).withColumn("cluster", unit)
    moments = rows.groupBy("method", "cluster").agg(*moment_columns(F.col("value"), F.col("centre")))
    w = weights(rows.select("cluster").distinct(), n_boot, seed)
    sums = moments.join(w, "cluster").groupBy("method", "rep").agg(*[F.sum(F.col(m) * F.col("w")).alias(m) for m in MOMENTS])
    scored = sums.select("method", "rep", *[c.alias(k) for k, c in from_moments().items()])
    tail = (1 - ci) / 2
    out = scored.groupBy("method").agg(*[f.alias(n) for m in METRICS for n, f in ((f"{m}_lo", F.percentile(m, tail)), (f"{m}_hi", F.percentile(m, 1 - tail)))], F.least(*[F.count(m) for m in METRICS]).alias("n_boot_used"))
    return out.withColumns({f"{m}_sci": (F.col(f"{m}_hi") - F.col(f"{m}_lo")) / 2 for m in METRICS})


def significance_matrix(scoring: DataFrame, *, n_boot: int = 10_000, seed: int = 0, alpha: float = 0.05, one_sided: bool = True, cluster: str | None = "card_a") -> DataFrame:
    """Per unordered pair of methods and metric: symbol, p and q of a paired bootstrap, long.

    Both methods of a pair are scored on the same rows, those where both are finite.
    """
    unit = F.col(cluster) if cluster else F.concat_ws("|", "card_a", "group_b")
    rows = centred(usable(scoring)).withColumn("cluster", unit)
    b = rows.select(F.col("method").alias("method_b"), "card_a", "group_b", F.col("value").alias("value_b"))
    both = rows.withColumnRenamed("method", "method_a").join(b, ["card_a", "group_b"]).where("method_a < method_b")
    pair = ["method_a", "method_b"]
    moments = both.groupBy(*pair, "cluster").agg(*moment_columns(F.col("value"), F.col("centre"), "_1"), *moment_columns(F.col("value_b"), F.col("centre"), "_2"))
    names = [f"{m}_{i}" for i in (1, 2) for m in MOMENTS]
    w = weights(rows.select("cluster").distinct(), n_boot, seed)
    drawn = moments.join(w, "cluster").groupBy(*pair, "rep").agg(*[F.sum(F.col(m) * F.col("w")).alias(m) for m in names])
    seen = moments.groupBy(*pair).agg(*[F.sum(m).alias(m) for m in names], F.count("*").alias("n_clusters"))
    one, two = from_moments("_1"), from_moments("_2")
    favour = [(ORIENTATION[m] * (one[m] - two[m])).alias(m) for m in METRICS]
    observed = seen.select(*pair, F.col("n_1").cast("long").alias("n_pairs"), "n_clusters", *favour).unpivot([*pair, "n_pairs", "n_clusters"], list(METRICS), "metric", "observed")
    repeated = drawn.select(*pair, "rep", *favour).unpivot([*pair, "rep"], list(METRICS), "metric", "d").where(finite(F.col("d")))
    # The differences are differences of floating sums; what is within rounding of zero counts as zero.
    sign = F.when(F.abs("observed") > 1e-12, F.signum("observed")).otherwise(0.0)
    test = repeated.join(observed, [*pair, "metric"]).groupBy(*pair, "metric").agg(F.count_if(F.col("d") * sign <= 1e-12).alias("crossings"), F.count("*").alias("n_finite"))
    p = (F.col("crossings") + 1) / (F.col("n_finite") + 1)
    p = p if one_sided else F.least(F.lit(1.0), 2 * p)
    clear = (sign != 0) & (F.col("n_finite") >= 2) & (F.col("n_pairs") >= 2) & (F.col("n_clusters") >= 2)
    out = observed.join(test, [*pair, "metric"], "left").withColumn("p", F.when(clear, p))
    out = benjamini_hochberg(out, "p", ["metric"], pair, alpha)
    symbol = F.when(F.col("reject") & (sign > 0), ">").when(F.col("reject") & (sign < 0), "<").otherwise("~")
    return out.select(*pair, "metric", "n_pairs", "n_clusters", symbol.alias("symbol"), "p", "q")


def significance_wide(long: DataFrame) -> DataFrame:
    """One row per pair of methods with a symbol per metric."""
    return long.groupBy("method_a", "method_b", "n_pairs", "n_clusters").agg(*[F.max(F.when(F.col("metric") == m, F.col("symbol"))).alias(m) for m in METRICS])


def disagreements(wide: DataFrame) -> DataFrame:
    """Pairs of methods on which the metrics do not all give the same significant verdict."""
    a = F.col
    return wide.where(~((a("rmse") != "~") & (a("rmse") == a("mae")) & (a("mae") == a("ccc")) & (a("ccc") == a("accuracy95"))))


def rank_separation(pairs: DataFrame, *, r: float = 0.2, threshold: float = 2.0, n_boot: int = 1000, seed: int = 0, value: str = "late", error: str = "se_late", fdr: float | None = None) -> DataFrame:
    """``pairs`` (card_a, group_b, value, error) with rank, z and keep.

    A row stays if it is more than ``threshold`` standard errors away from the bootstrap
    mean of the value ``r`` of the ranks below or above; with ``fdr``, if its two-sided tail is
    rejected by Benjamini-Hochberg at that level.
    """
    rows = pairs.where(finite(F.col(value)) & finite(F.col(error))).select("card_a", "group_b", F.col(value).alias("v"), F.col(error).alias("se"))
    n = rows.count()
    k = int(n * r)
    if n_boot < 2 or (n and (k <= 0 or 2 * k > n)):
        raise ValueError(f"r={r} and n_boot={n_boot} do not suit {n} rows")
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy("v", "card_a", "group_b")) - 1)
    drawn = ranked.select(F.col("rank").alias("slot")).crossJoin(replicates(pairs.sparkSession, n_boot)).select("rep", draw(seed, F.col("rep"), F.col("slot"), F.lit(max(n, 1))).alias("rank"))
    values = drawn.join(F.broadcast(ranked.select("rank", "v")), "rank")
    ordered = values.withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy("v")) - 1)
    stats = ordered.groupBy("rank").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    out = ranked
    for name, step in (("back", k), ("fore", -k)):
        out = out.join(stats.select((F.col("rank") + step).alias("rank"), F.col("mean").alias(f"mean_{name}"), F.col("sd").alias(f"sd_{name}")), "rank", "left")
    se = F.when(F.col("se") > 0, F.col("se")).otherwise(1e-9)
    z = [F.coalesce(F.abs(F.col("v") - F.col(f"mean_{x}")) / F.sqrt(se * se + F.col(f"sd_{x}") * F.col(f"sd_{x}")), F.lit(0.0)) for x in ("back", "fore")]
    out = out.withColumn("z", F.greatest(*z))
    if fdr is None:
        out = out.withColumn("reject", F.col("z") > threshold)
    else:
        out = benjamini_hochberg(out.withColumn("p", 2 * upper_tail(F.col("z"))), "p", [F.lit(0)], ["rank"], fdr)
    return out.select("card_a", "group_b", "rank", "z", F.col("reject").alias("keep"))


def rsc_sensitivity(scoring: DataFrame, values: tuple[float, ...], *, vary: str = "r", fixed: float = 1.96, n_boot: int = 1000, seed: int = 0, by: str | None = None) -> DataFrame:
    """For each r (or threshold): share of pairs kept, and rank agreement of the scores with those on all pairs.

    ``by`` names a column of sets (few): pairs are ranked and filtered within each, and scored together.
    """
    from .metrics import method_scores, rank_spearman

    keys = ["card_a", "group_b", *([by] if by else [])]
    sets = [r[0] for r in scoring.select(by).distinct().collect()] if by else [None]
    base = method_scores(scoring).withColumn("variant", F.lit("a"))
    out = None
    for x in values:
        r, threshold = (x, fixed) if vary == "r" else (fixed, x)
        kept = None
        for name in sets:
            pairs = (scoring.where(F.col(by) == name) if by else scoring).select("card_a", "group_b", "late", "se_late").distinct()
            one = rank_separation(pairs, r=r, threshold=threshold, n_boot=n_boot, seed=seed)
            one = one.withColumn(by, F.lit(name)) if by else one
            kept = one if kept is None else kept.unionByName(one)
        some = scoring.join(kept.where("keep").select(*keys), keys, "left_semi")
        rho = rank_spearman(base.unionByName(method_scores(some).withColumn("variant", F.lit("b"))))
        share = kept.agg(F.avg(F.col("keep").cast("double")).alias("remaining"))
        one = share.crossJoin(rho.agg(*[F.max(F.when(F.col("metric") == m, F.col("rho"))).alias(m) for m in METRICS])).withColumn("value", F.lit(float(x)))
        out = one if out is None else out.unionByName(one)
    return out.select("value", "remaining", *METRICS)
