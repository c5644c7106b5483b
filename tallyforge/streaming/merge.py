"""Sufficient statistics from a stream of drafts.

The sums of ``iv.sufficient_stats`` are additive over drafts, so each micro-batch of whole
drafts adds its own to a table kept by batch; reading sums over the batches. A batch that is
run again replaces its own part, which makes restarts exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.iv import sufficient_stats
from ..sources.tables import Facts, pack_offers

SUMS = ("n", "sum_d", "sum_y", "sum_y_sq", "sum_dy")


def merge_batches(picks: DataFrame, cards: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write statistics of every micro-batch of ``picks`` (whole drafts) under ``path``."""

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            found = sufficient_stats(Facts(batch, pack_offers(batch), cards))
            found.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return picks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The statistics of all batches so far."""
    return spark.read.parquet(path).groupBy("card_a", "group_b", "z").agg(*[F.sum(c).alias(c) for c in SUMS])
