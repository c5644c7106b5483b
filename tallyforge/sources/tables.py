"""Draft facts derived from the order tables, in place of real draft logs.

A customer's purchases in time order are a draft of three packs of ten picks; a brand is a
card. Card attributes are arithmetic on the brand's number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import changed_at, stored

PACK_SIZE = 10
COLORS = ("W", "U", "B", "R", "G")


@dataclass
class Facts:
    """picks: draft_id, pack, pick_no, card. offers: draft_id, pack, card, n_first (copies in the
    pack's first offer), n_rows (offers that show the card). cards: card and its attributes."""

    picks: DataFrame
    offers: DataFrame
    cards: DataFrame
    kept: dict[str, Any] = field(default_factory=dict)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table derived from these facts, built and stored at first use: several operators read it."""
        if name not in self.kept:
            self.kept[name] = stored(build(), name)
        return self.kept[name]


def order_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty purchases of each customer.

    Of two lines equal in order, line number and part either may come first, since they are the same card: what else
    the lines hold need not be shuffled.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    # Named before the shuffle, so that what follows by draft needs no other.
    rows = rows.select(F.col("o_custkey").alias("draft_id"), "o_orderdate", "o_orderkey", "l_linenumber", "l_partkey", F.col("p_brand").alias("card"))
    order = Window.partitionBy("draft_id").orderBy("o_orderdate", "o_orderkey", "l_linenumber", "l_partkey")
    numbered = rows.select("draft_id", (F.row_number().over(order) - 1).alias("rn"), "card").where(F.col("rn") < 3 * PACK_SIZE)
    return numbered.select("draft_id", F.expr(f"rn div {PACK_SIZE}").cast("int").alias("pack"), (F.col("rn") % PACK_SIZE).cast("int").alias("pick_no"), "card")


def pack_offers(picks: DataFrame) -> DataFrame:
    """What the packs showed: at every pick the cards of this and all later picks of the pack."""
    return picks.groupBy("draft_id", "pack", "card").agg(F.count("*").alias("n_first"), (F.max("pick_no") + 1).cast("long").alias("n_rows"))


def shown(picks: DataFrame) -> DataFrame:
    """Picks with ``pack_offers`` of their card beside them, ``once`` in a pack: where picks lie by draft, nothing is shuffled."""
    same = Window.partitionBy("draft_id", "pack", "card")
    return picks.withColumns({"n_first": F.count("*").over(same), "n_rows": (F.max("pick_no").over(same) + 1).cast("long"), "once": F.col("pick_no") == F.min("pick_no").over(same)})


def brand_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card attributes: group, color flags and pips, mana value, rarity, land and creature flags."""
    no = F.col("no")
    color = F.element_at(F.array(*map(F.lit, COLORS)), (no % 5 + 1).cast("int"))
    second = F.when(no % 4 == 0, F.element_at(F.array(*map(F.lit, COLORS)), ((no + 2) % 5 + 1).cast("int")))
    base = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("card")).distinct()
    base = base.withColumn("no", F.substring_index("card", "#", -1).cast("int"))
    flags = [((color == c) | F.coalesce(second == c, F.lit(False))).cast("int").alias(f"is_{c}") for c in COLORS]
    pips = [(F.when(color == c, 1 + no % 3).otherwise(0) + F.when(second == c, 1).otherwise(0)).cast("int").alias(f"pip_{c}") for c in COLORS]
    return base.select("card", "no", color.alias("group_b"), *flags, *pips, (no % 7).alias("mv"), (no % 5 == 0).cast("int").alias("rare"), (no % 9 == 0).cast("int").alias("land"), (no % 2 == 0).cast("int").alias("creature"))


#: Facts built in this process, by application, folder and state of the tables read.
_BUILT: dict[tuple, Facts] = {}


def order_facts(spark: SparkSession, sf_dir: str) -> Facts:
    """The facts, built once per state of the tables and stored: every operator reads them several times."""
    key = (spark.sparkContext.applicationId, sf_dir, *(changed_at(spark, f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part")))
    if key not in _BUILT:
        # One shuffle, by customer, gives both tables.
        both = stored(shown(order_picks(spark, sf_dir)), "picks")
        offers = both.where("once").select("draft_id", "pack", "card", "n_first", "n_rows")
        _BUILT[key] = Facts(both.select("draft_id", "pack", "pick_no", "card"), offers, stored(brand_cards(spark, sf_dir), "cards"))
    return _BUILT[key]
