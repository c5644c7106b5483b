"""Sharding by a hypergeometric communication matrix.

The rows stand in hashed partitions. A matrix of partition-to-shard counts is drawn from
the law of a uniform shuffle given all partition sizes and shard sizes (a multivariate
hypergeometric draw, one partition after the other). Each partition permutes its rows and
deals them out along its matrix row, the rows are exchanged, and each shard permutes what
it got. Shard sizes are exact: they differ by one row at most (law ``rows``).

The driver holds the matrix only, at most ``MAX_PARTS`` times the number of shards.
A shard is permuted in sub-ranges of its order key, so no shard is sorted in one task.

Defined cases: a null text has no bytes; rows that repeat are separate rows and get slots
of their own; with fewer rows than shards the last shards stay empty; an empty table gives
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read, text_crc32

SHARDS = 40
OVERHEAD = 16
ROWS_PER_PART = 20_000
#: Partitions that are dealt out at least.
LEAST_PARTS = 64
MAX_PARTS = 4_096
MAX_RANGES = 256
#: Keys of repeated rows up to which they are broadcast (three numbers each).
BROADCAST_REPEATS = 100_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw by inversion of the distribution around its mode, for counts of any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    sd = math.sqrt(draws * (good / total) * (bad / total) * max(1, total - draws) / max(1, total - 1))
    a, b = max(low, mode - int(14 * sd) - 20), min(high, mode + int(14 * sd) + 20)
    x = np.arange(a, b, dtype=np.float64)
    ratio = np.log(good - x) + np.log(draws - x) - np.log(x + 1) - np.log(bad - draws + x + 1)
    log_p = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return a + min(int(np.searchsorted(p, rng.random() * p[-1], side="right")), b - a)


def communication_matrix(part_sizes: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Counts with the given row and column sums, drawn as a uniform shuffle would give them."""
    rng = np.random.default_rng(seed)
    left = list(shard_sizes)
    out = np.zeros((len(part_sizes), len(left)), dtype=np.int64)
    for i, n in enumerate(part_sizes):
        rest = sum(left)
        for j, room in enumerate(left):
            take = hypergeometric(rng, room, rest - room, n)
            out[i, j] = take
            n, rest = n - take, rest - room
        left = [a - int(b) for a, b in zip(left, out[i], strict=True)]
    return out


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Equality of the key that rows are told apart by: id, checksum and size."""
    return a["id"].eqNullSafe(b["id"]) & (a["crc"] == b["crc"]) & (a["size"] == b["size"])


def planned(docs: DataFrame, scratch: Scratch, shards: int, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """``id, crc, size, repeated, shard, slot`` of every row of ``docs``, and the keys that several rows share, if any."""
    spark = docs.sparkSession
    thin = docs.select(F.col("doc_id").alias("id"), text_crc32(F.col("text")).alias("crc"), size_of(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row"))
    thin = scratch.keep(thin)
    n = thin.count()
    # Rows that repeat are told apart by their number in the stored table, so that they are dealt out like others.
    again = scratch.keep(thin.groupBy("id", "crc", "size").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    repeats = again.count()
    if repeats:
        known = again.select(*(F.col(c).alias(c) for c in ("id", "crc", "size")), F.lit(True).alias("repeated"))
        known = F.broadcast(known) if repeats <= BROADCAST_REPEATS else known
        thin = thin.join(known, same_row(thin, known), "left").select(thin["id"], thin["crc"], thin["size"], F.coalesce("repeated", F.lit(False)).alias("repeated"), "row")
    else:
        thin = thin.withColumn("repeated", F.lit(False))
    salt = F.when(F.col("repeated"), F.col("row")).otherwise(F.lit(0))
    h = lambda k: F.xxhash64("id", "crc", salt, F.lit(seed + k))

    parts = max(1, min(n, max(LEAST_PARTS, min(MAX_PARTS, n // ROWS_PER_PART))))
    ranges = max(1, min(MAX_RANGES, n // (shards * ROWS_PER_PART)))
    thin = thin.withColumn("part", F.pmod(h(0), F.lit(parts)).cast("int"))
    sizes = dict(thin.groupBy("part").agg(F.count("*").alias("n")).collect())
    sizes = {p: sizes[p] for p in sorted(sizes)}
    matrix = communication_matrix(list(sizes.values()), [n // shards + (j < n % shards) for j in range(shards)], seed)
    ends = spark.createDataFrame([(p, [int(x) for x in row]) for p, row in zip(sizes, matrix.cumsum(axis=1), strict=True)], "part int, ends array<long>")

    local = Window.partitionBy("part").orderBy(h(1), "id", "crc", "size", "row")
    dealt = thin.withColumn("at", F.row_number().over(local) - 1).join(F.broadcast(ends), "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("at"))))
    order = h(2)
    dealt = scratch.keep(dealt.select("id", "crc", "size", "repeated", "row", "shard", order.alias("order"), F.pmod(F.shiftrightunsigned(order, 40), F.lit(ranges)).cast("int").alias("range")))

    counts = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).drop("n")
    last = Window.partitionBy("shard", "range").orderBy("order", "id", "crc", "size", "row")
    # At most shards * MAX_RANGES rows, so safe to broadcast.
    out = dealt.withColumn("rank", F.row_number().over(last) - 1).join(F.broadcast(starts), ["shard", "range"])
    return out.select("id", "crc", "size", "repeated", "shard", (F.col("start") + F.col("rank")).alias("slot")), again if repeats else None


def shard(docs: DataFrame, *, shards: int = SHARDS, seed: int = 23) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot."""
    plan, _ = planned(docs, Scratch(docs.sparkSession, "shard"), shards, seed)
    return plan.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def sharded_documents(docs: DataFrame, *, shards: int = SHARDS, seed: int = 23) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (columns of these names are replaced).

    Rows equal in doc_id and text are interchangeable: the n-th of them in the plan goes to
    the n-th of them in ``docs``. Texts are exchanged once, those of repeated rows twice.
    """
    scratch = Scratch(docs.sparkSession, "sharded")
    plan, again = planned(docs, scratch, shards, seed)
    plan = scratch.keep(plan)
    docs = docs.drop("shard", "slot")
    # The documents' own columns travel in a struct, so that no name can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_crc32(F.col("text")).alias("crc"), size_of(F.col("text")).alias("size"))
    once = plan.where(~F.col("repeated"))
    out = rows.join(once, same_row(rows, once)).select("row", "shard", "slot")
    if again is not None:
        again = F.broadcast(again) if again.count() <= BROADCAST_REPEATS else again
        nth = F.row_number().over(Window.partitionBy("id", "crc", "size").orderBy("id"))
        mine = rows.join(again, same_row(rows, again), "left_semi").withColumn("nth", nth)
        theirs = plan.where("repeated").withColumn("nth", nth)
        more = mine.join(theirs, same_row(mine, theirs) & (mine["nth"] == theirs["nth"]))
        out = out.unionByName(more.select("row", "shard", "slot"))
    return out.select("row.*", "shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
