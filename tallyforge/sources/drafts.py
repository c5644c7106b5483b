"""Draft logs as exported: wide CSV, card metadata and groupings in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import stored
from .tables import Facts

PACK_PREFIX = "pack_card_"
REQUIRED = ("draft_id", "pack_number", "pick_number", "pick")
TYPES = ("Creature", "Instant", "Sorcery", "Artifact", "Enchantment", "Land", "Planeswalker")


def card_columns(df: DataFrame, expected: list[str] | None = None) -> list[str]:
    """The pack columns of a draft log; raises if columns are missing or the card pool differs."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"draft log lacks columns {missing}")
    cards = [c.removeprefix(PACK_PREFIX) for c in df.columns if c.startswith(PACK_PREFIX)]
    if not cards:
        raise ValueError(f"draft log has no {PACK_PREFIX} columns")
    if expected is not None and set(cards) != set(expected):
        raise ValueError("draft log has another card pool than expected")
    return cards


def read_log(spark: SparkSession, path: str, *, located: bool = False) -> DataFrame:
    """A wide draft log (CSV, plain or gzipped), every cell a string, blank cells null.

    ``pool_`` columns are left out of the scan by column pruning. ``located`` adds where a row
    stands (``_file``, ``_block``, ``_row``), from which ``placed`` makes its place.
    """
    log = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if not located:
        return log
    return log.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))


def placed(log: DataFrame) -> DataFrame:
    """``row_pos``, the place of a located row over all files in order of path, in place of where it stands.

    Rows of a block are numbered in order within one task, so its number of rows and first number
    are all that is needed: three values a block of the log come to the driver.
    """
    blocks = log.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_row").alias("first")).collect()
    shifts, total = [], 0
    for r in sorted(blocks, key=lambda r: (r["_file"], r["_block"])):
        shifts.append((r["_file"], r["_block"], total - r["first"]))
        total += r["n"]
    known = log.sparkSession.createDataFrame(shifts, "_file string, _block long, _shift long")
    return log.join(F.broadcast(known), ["_file", "_block"]).withColumn("row_pos", F.col("_row") + F.col("_shift")).drop("_file", "_block", "_row", "_shift")


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with its rows' numbers from 0 in order of ``by``, without a global window.

    A range exchange deals the order over partitions; one number a partition gives the offsets.
    """
    order = stored(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["p"], r["n"]) for r in order.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    known = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return order.withColumn("_part", part).join(F.broadcast(known), "_part").withColumn(name, F.col("_start") + place).drop("_at", "_part", "_start")


def runs(df: DataFrame) -> DataFrame:
    """``draft_id`` made unique per contiguous run, for logs whose ids come back.

    Needs a ``row_pos`` column with the row's place in the file. Within a run the place less
    the row's number among its draft's rows is constant, so each draft is looked at by itself.
    """
    order = Window.partitionBy("draft_id").orderBy("row_pos")
    return df.withColumn("_run", F.col("row_pos") - F.row_number().over(order)).withColumn("draft_id", F.concat_ws("/", "draft_id", F.col("_run").cast("string"))).drop("_run")


def facts(log: DataFrame, cards: DataFrame, expected: list[str] | None = None) -> Facts:
    """Narrow picks and offers from a wide log; ``cards`` holds the attributes."""
    names = card_columns(log, expected)
    keys = [F.col("draft_id"), F.col("pack_number").cast("int").alias("pack"), F.col("pick_number").cast("int").alias("pick_no")]
    picks = log.select(*keys, F.col("pick").alias("card"))
    # One array of (card, copies) a row, emptied of absent cards before it is exploded.
    cells = F.array(*[F.struct(F.lit(c).alias("card"), F.expr(f"try_cast(`{PACK_PREFIX}{c}` AS double)").alias("n")) for c in names])
    shown = log.select(*keys, F.explode(F.filter(cells, lambda x: F.coalesce(x["n"], F.lit(0.0)) > 0)).alias("x")).select("draft_id", "pack", "pick_no", "x.card", "x.n")
    offers = shown.groupBy("draft_id", "pack", "card").agg(F.coalesce(F.max(F.when(F.col("pick_no") == 0, F.col("n"))), F.lit(0.0)).cast("long").alias("n_first"), F.count("*").alias("n_rows"))
    return Facts(picks, offers, cards)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """card, group_b from a JSON map of card names to labels."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("card", "group_b"))


CARD_SCHEMA = "name string, colors array<string>, color_identity array<string>, mana_cost string, cmc double, type_line string, rarity string, card_faces array<struct<colors:array<string>>>"


def read_card_pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Card metadata from saved API pages (``data`` arrays), later pages and paths winning by name."""
    frames = []
    for i, path in enumerate(paths):
        page = spark.read.schema(f"data {_card_array()}").json(path, multiLine=True)
        cards = page.select(F.input_file_name().alias("file"), F.posexplode("data").alias("at", "c"))
        frames.append(cards.select(F.lit(i).alias("source"), "file", "at", "c.*"))
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("source"), F.desc("file"), F.desc("at")))
    return every.withColumn("_n", last).where("_n = 1").drop("_n", "source", "file", "at")


def _card_array() -> str:
    fields = ",".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in CARD_SCHEMA.split(", ")))
    return f"array<struct<{fields}>>"


def build_or_read(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at ``path``, built and written first if it is not there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.parquet(path)
    return spark.read.parquet(path)


def write_estimates(estimates: DataFrame, path: str) -> None:
    """Estimates partitioned by method and card, so that one card can be redone alone."""
    estimates.write.mode("overwrite").partitionBy("method", "card_a").parquet(path)


def shard_name(method: str, set_code: str, card: str) -> str:
    """The file name of one card's shard of a method."""
    import zlib

    return f"{method}.{set_code}.{zlib.crc32(card.encode()):08x}.csv"


def read_estimates(spark: SparkSession, path: str) -> DataFrame:
    """Estimates as written; raises if a (method, card, group) is there twice."""
    out = spark.read.parquet(path)
    if out.groupBy("method", "card_a", "group_b").count().where("count > 1").limit(1).count():
        raise ValueError(f"{path} holds a pair of a method twice")
    return out
