"""Scoring of estimates against reference effects.

Everything works on long frames: method, card_a, group_b, value, late, se_late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Z_95, t_half_width

METRICS = ("rmse", "mae", "ccc", "accuracy95")
#: +1 where more is better.
ORIENTATION = {"rmse": -1, "mae": -1, "ccc": 1, "accuracy95": 1}


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def needs(df: DataFrame, *columns: str) -> None:
    """Raises if ``df`` lacks columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns {missing} are missing")


def enrich(pairs: DataFrame, estimates: DataFrame, *, require_finite: bool = False) -> DataFrame:
    """Pairs with every method's estimates, long; raises on missing or repeated pairs.

    A count of the pairs and one aggregate by method find all violations; a row a method comes to the driver.
    """
    keys = ["card_a", "group_b"]
    needs(pairs, *keys)
    needs(estimates, "method", *keys, "value")
    if clash := set(pairs.columns) & set(estimates.columns) - set(keys):
        raise ValueError(f"pairs and estimates share columns {sorted(clash)}")
    wanted = pairs.select(*keys).distinct()
    given = estimates.groupBy("method", *keys).agg(F.count("*").alias("n"), F.count_if(~finite(F.col("value"))).alias("odd"))
    marked = wanted.withColumn("wanted", F.lit(1)).join(given, keys, "full")
    found = marked.groupBy("method").agg(F.count_if(F.col("n") > 1).alias("twice"), F.count("wanted").alias("covered"), F.sum("odd").alias("odd")).collect()
    n_pairs = wanted.count()
    # Pairs that no method has come under a null method.
    bare = sum(r["covered"] for r in found if r["method"] is None)
    seen = [r for r in found if r["method"] is not None]
    if any(r["twice"] for r in seen):
        raise ValueError("a method has a pair twice")
    if seen and (bare or any(r["covered"] < n_pairs for r in seen)):
        raise ValueError("a method lacks a pair")
    if require_finite and any(r["odd"] for r in seen):
        raise ValueError("an estimate is not finite")
    return pairs.join(estimates, keys, "left")


def null_baselines(truth: DataFrame, *, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Estimates of 0 and of the mean effect, with seeded noise if wanted."""
    mean = truth.where(finite(F.col("late"))).agg(F.avg("late").alias("mean"))
    base = truth.select("card_a", "group_b").crossJoin(F.broadcast(mean))
    jitter = F.randn(seed) * noise if noise else F.lit(0.0)
    two = F.explode(F.array(F.struct(F.lit("null_zero").alias("method"), F.lit(0.0).alias("value")), F.struct(F.lit("null_mean").alias("method"), F.col("mean").alias("value"))))
    return base.select("card_a", "group_b", two.alias("x")).select("x.method", "card_a", "group_b", (F.col("x.value") + jitter).alias("value"))


def usable(scoring: DataFrame) -> DataFrame:
    value = F.col("value").try_cast("double")
    return scoring.withColumn("value", value).where(finite(value) & finite(F.col("late")))


def samplewise(scoring: DataFrame, *, weighted: bool = False) -> DataFrame:
    """Squared and absolute error and coverage by sample; ids follow (card_a, group_b)."""
    ids = F.dense_rank().over(Window.orderBy("card_a", "group_b")) - 1
    keys = scoring.select("card_a", "group_b").distinct().withColumn("sample_id", ids)
    err = F.col("value") - F.col("late")
    has_se = finite(F.col("se_late")) & (F.col("se_late") > 0)
    scaled = F.when(has_se, err / F.nullif("se_late", F.lit(0.0))) if weighted else err
    rows = usable(scoring).join(keys, ["card_a", "group_b"])
    return rows.select("sample_id", "method", (scaled * scaled).alias("sq_err"), F.abs(scaled).alias("abs_err"), F.when(has_se, (F.abs(err) <= Z_95 * F.col("se_late")).cast("int")).alias("covered"))


def moment_columns(value: Column, centre: Column, suffix: str = "") -> list[Column]:
    """Sums from which all metrics follow; values are centred first, against cancellation."""
    e, t, d = value - centre, F.col("late") - centre, value - F.col("late")
    has_se = finite(F.col("se_late")) & (F.col("se_late") > 0)
    parts = {"n": F.lit(1.0), "e": e, "t": t, "ee": e * e, "tt": t * t, "et": e * t, "dd": d * d, "ad": F.abs(d), "ns": has_se.cast("double"), "cov": (has_se & (F.abs(d) <= Z_95 * F.col("se_late"))).cast("double")}
    return [F.sum(c).alias(f"{k}{suffix}") for k, c in parts.items()]


MOMENTS = ("n", "e", "t", "ee", "tt", "et", "dd", "ad", "ns", "cov")


def from_moments(suffix: str = "") -> dict[str, Column]:
    """The metrics from sums; undefined ones null."""
    m = {k: F.col(f"{k}{suffix}") for k in MOMENTS}
    n = F.nullif(m["n"], F.lit(0.0))
    var = lambda s, q: m[q] / n - (m[s] / n) * (m[s] / n)
    cov = m["et"] / n - (m["e"] / n) * (m["t"] / n)
    gap = (m["e"] - m["t"]) / n
    spread = var("e", "ee") + var("t", "tt") + gap * gap
    return {"rmse": F.sqrt(m["dd"] / n), "mae": m["ad"] / n, "ccc": F.when((m["n"] >= 2) & (spread > 1e-18), 2 * cov / F.nullif(spread, F.lit(0.0))), "accuracy95": m["cov"] / F.nullif(m["ns"], F.lit(0.0))}


def centred(rows: DataFrame) -> DataFrame:
    """Adds ``centre``, the mean effect over all rows: one number."""
    return rows.crossJoin(F.broadcast(rows.agg(F.avg("late").alias("centre"))))


def method_scores(scoring: DataFrame) -> DataFrame:
    """One row per method, best rmse first, undefined last; missing columns raise."""
    needs(scoring, "method", "value", "late", "se_late")
    sums = centred(usable(scoring)).groupBy("method").agg(*moment_columns(F.col("value"), F.col("centre")))
    out = sums.select("method", F.col("n").cast("long").alias("n_used"), F.col("ns").cast("long").alias("n_used_se"), *[c.alias(k) for k, c in from_moments().items()])
    return out.orderBy(F.asc_nulls_last("rmse"), "method")


def rank_spearman(scores: DataFrame) -> DataFrame:
    """Spearman correlation of the methods' order between variants: variant, method, metric columns.

    Ranks are average ranks within a variant, of values rounded to nine digits; correlations are one self-join per metric.
    """
    long = scores.unpivot(["variant", "method"], list(METRICS), "metric", "x").where(finite(F.col("x"))).withColumn("x", F.round("x", 9))
    by = Window.partitionBy("metric", "variant")
    low = F.rank().over(by.orderBy("x"))
    same = F.count("*").over(Window.partitionBy("metric", "variant", "x"))
    ranks = long.withColumn("rank", low + (same - 1) / 2.0)
    b = ranks.select("metric", "method", F.col("variant").alias("variant_b"), F.col("rank").alias("rank_b"))
    both = ranks.select("metric", "method", F.col("variant").alias("variant_a"), F.col("rank").alias("rank_a")).join(b, ["metric", "method"])
    return both.where("variant_a < variant_b").groupBy("metric", "variant_a", "variant_b").agg((F.covar_pop("rank_a", "rank_b") / F.nullif(F.stddev_pop("rank_a") * F.stddev_pop("rank_b"), F.lit(0.0))).alias("rho"))


def value_per_quanta(rows: DataFrame, x: str, y: str, *, bins: int = 5, quantile: bool = True, last: bool = False, level: float | None = None) -> DataFrame:
    """Mean and standard error of ``y`` in bins of ``x``; the last, closed bin is left out unless asked for.

    ``level`` adds the half width of the t interval of the mean.
    """
    if quantile:
        edges = rows.agg(F.percentile(x, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("edges"))
    else:
        lo, hi = F.min(x), F.max(x)
        edges = rows.agg(F.array(*[lo + (hi - lo) * F.lit(i / bins) for i in range(bins + 1)]).alias("edges"))
    placed = rows.crossJoin(F.broadcast(edges)).where(F.col(x).isNotNull())
    inside = [(F.col(x) >= F.get("edges", i)) & ((F.col(x) < F.get("edges", i + 1)) if i < bins - 1 else (F.col(x) <= F.get("edges", i + 1))) for i in range(bins)]
    bin_no = F.coalesce(*[F.when(c, i) for i, c in enumerate(inside)])
    out = placed.withColumn("bin", bin_no).where(F.col("bin") < (bins if last else bins - 1)).groupBy("bin")
    out = out.agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), (F.stddev_samp(y) / F.sqrt(F.count("*"))).alias("sem_y"))
    if level is not None:
        out = out.withColumn("half_y", t_half_width(F.col("sem_y"), F.col("n"), level))
    return out.orderBy("bin")


def set_summary(pairs: DataFrame) -> DataFrame:
    """Pairs, cards and groups per set code, and over all sets (distinct ones counted once)."""
    what = [F.count("*").alias("n_pairs"), F.countDistinct("card_a").alias("n_cards"), F.countDistinct("group_b").alias("n_groups")]
    return pairs.groupBy("set_code").agg(*what).unionByName(pairs.agg(*what).withColumn("set_code", F.lit("All")))
