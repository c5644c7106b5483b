"""Instrumental-variable state that is kept by source file and merged.

A source (a log file, a day, a micro-batch) leaves one small table: the sums of
``iv.sufficient_stats`` by card, group and arm, and the accounting by card. Sums add up, extremes
are taken over sources, so any split of a log into sources of whole drafts gives the effects and the
accounting of one pass. A source put again replaces its own part; a removed one is gone from the next
merge. Sources must share one card table, since a draft counts for every card it did not see.
"""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import upper_tail
from ..sources import manifest
from ..sources.tables import Facts
from .facts import ASSIGNMENT, draft_accounting
from .iv import sufficient_stats, wald

KIND, VERSION = "iv_state", 1
SUMS = ("n", "sum_d", "sum_y", "sum_y_sq", "sum_dy")
COUNTS = ("n_valid", "n_invalid", "n_incomplete", "n_no_outcome", "n_offered", "n_treated", "horizon_total")


def state(facts: Facts) -> DataFrame:
    """Sums by card, group and arm, and accounting by card (rows without a group)."""
    sums = sufficient_stats(facts).select("card_a", "group_b", "z", *[F.col(c).cast("long").alias(c) for c in SUMS])
    counts = draft_accounting(facts).select("card_a", *[F.col(c).cast("long").alias(c) for c in (*COUNTS, "horizon_min", "horizon_max")])
    return sums.unionByName(counts, allowMissingColumns=True).coalesce(1)


def cards_mark(cards: DataFrame) -> list[int]:
    """A mark of a card table's names and groups, the same for any order of rows."""
    return list(cards.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("card", "group_b").cast("decimal(38,0)")), F.lit(0)).cast("string")).first())


def folder(path: str, source: str) -> str:
    """Where a source's state lies: its name with all but plain characters escaped, no percent signs among them."""
    return f"{path}/source={quote(source, safe='').replace('~', '%7E').replace('%', '~')}"


def put(facts: Facts, path: str, source: str) -> None:
    """Store the state of a source, in place of what it had."""
    unsure = {"no_card": F.col("card_a").isNull(), "negative": (F.col("n") < 0) | (F.col("n_valid") < 0)}
    manifest.save(state(facts), folder(path, source), KIND, VERSION, source={"cards": cards_mark(facts.cards)}, checks=unsure)


def remove(spark: SparkSession, path: str, source: str) -> None:
    """Forget a source."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder(path, source))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def merge(spark: SparkSession, path: str) -> DataFrame:
    """The state of all sources together: one scan of their newest tables."""
    pages = spark.read.text(f"{path}/source=*/manifest-*", wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    # One line a source and publication, of some hundred bytes; sources are files of a log or batches.
    newest = {r["file"].rsplit("/", 1)[0]: json.loads(r["value"]) for r in sorted(pages.collect(), key=lambda r: r["file"])}
    if odd := [s for s, m in newest.items() if (m["kind"], m["version"]) != (KIND, VERSION)]:
        raise manifest.CheckFailed(f"not {KIND} of version {VERSION}: {odd}")
    if len({str(m["source"]["cards"]) for m in newest.values()}) > 1:
        raise manifest.CheckFailed("sources were built with different card tables")
    for place, m in newest.items():
        manifest.whole(spark, place, m)
    schema = manifest.schema_of(next(iter(newest.values())))
    every = spark.read.schema(schema).parquet(*[f"{place}/{m['data']}" for place, m in newest.items()])
    both = [F.sum(c).alias(c) for c in (*SUMS, *COUNTS)]
    return every.groupBy("card_a", "group_b", "z").agg(*both, F.min("horizon_min").alias("horizon_min"), F.max("horizon_max").alias("horizon_max"))


def accounting(merged: DataFrame) -> DataFrame:
    """Per card: the accounting over all sources."""
    mean = F.col("horizon_total") / F.nullif(F.col("n_valid"), F.lit(0))
    return merged.where("group_b is null").select("card_a", *COUNTS, mean.alias("horizon_mean"), "horizon_min", "horizon_max")


def effects(merged: DataFrame) -> DataFrame:
    """The reference effects of a merged state."""
    arm = lambda z, c: F.coalesce(F.sum(F.when(F.col("z") == z, F.col(c))), F.lit(0)).alias(f"{c}_{z}")
    both = merged.where("group_b is not null").groupBy("card_a", "group_b").agg(*[arm(z, c) for z in (0, 1) for c in SUMS])
    found = wald(*[F.col(f"{c}_1") for c in ("n", "sum_d", "sum_y", "sum_y_sq", "sum_dy")], *[F.col(f"{c}_0") for c in ("n", "sum_y", "sum_y_sq")])
    out = both.where("n_1 >= 2 and n_0 >= 2 and sum_d_1 > 0").select("card_a", "group_b", F.lit(ASSIGNMENT).alias("pack"), *[c.alias(k) for k, c in found.items()])
    z = F.when(F.col("se_late") > 0, F.col("late") / F.nullif("se_late", F.lit(0.0))).otherwise(0.0)
    out = out.withColumn("z_stat", z).withColumn("p_value", 2 * upper_tail(F.abs("z_stat")))
    return out.join(F.broadcast(accounting(merged)), "card_a")
