"""False-discovery control in windows over p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def benjamini_hochberg(df: DataFrame, p: str, by: list[Column | str], order: list[Column | str], alpha: float = 0.05) -> DataFrame:
    """Adds ``q`` (adjusted p, running minimum from the top) and ``reject`` within each family ``by``.

    Null and non-finite p-values take no part and are never rejected.
    """
    value = F.when(F.isnan(p), None).otherwise(F.col(p))
    family = Window.partitionBy(*by, F.col("_p").isNull())
    out = df.withColumn("_p", value).withColumn("_rank", F.row_number().over(family.orderBy("_p", *order))).withColumn("_n", F.count("*").over(family))
    upward = family.orderBy("_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    q = F.least(F.lit(1.0), F.min(F.col("_p") * F.col("_n") / F.col("_rank")).over(upward))
    last = F.max(F.when(F.col("_p") <= F.lit(alpha) * F.col("_rank") / F.col("_n"), F.col("_rank"))).over(family)
    out = out.withColumn("q", F.when(F.col("_p").isNotNull(), q)).withColumn("reject", F.col("_p").isNotNull() & (F.col("_rank") <= F.coalesce(last, F.lit(0))))
    return out.drop("_p", "_rank", "_n")
