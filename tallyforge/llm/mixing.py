"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key divided by its quality weight. Within a source the
documents stand in key order, and the prefix sums of their words say how far the source's
budget reaches. A budget of ``e`` whole source sizes and a rest takes every document ``e``
times (complete epochs) before the rest selects along the key order; the document at which
the rest ends is taken in part, so a source meets its target to the word.

No source is sorted as a whole. Keys are put into at most ``MAX_BINS`` bins that are
monotone in the key; word sums per (source, bin) find the one bin in which the rest ends,
and only that bin's rows are sorted.

Defined cases: a null text has size 0; null is a source of its own, last in order; ties in
the key fall by doc_id and text hash; rows that repeat are separate rows; a table without
words has targets of 0; an empty table gives no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, no_bigger, read

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
ROWS_PER_BIN = 256
MAX_BINS = 65_536
#: Sources up to which the table of targets (five numbers a source) is broadcast.
BROADCAST_SOURCES = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drawn(seed: int) -> Column:
    """A number strictly between 0 and 1 for each row, from the digest of seed, id and text, so that SQL can draw it too."""
    row = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    digits = F.conv(F.substring(F.md5(row.cast("binary")), 1, 13), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 52))


def quality_weight(quality: Column) -> Column:
    """Documents labelled good come earlier in the key order, those labelled poor later."""
    return F.when(quality >= 1, F.lit(2.0)).when(quality <= 0, F.lit(0.5)).otherwise(F.lit(1.0))


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources`` with ``rank`` from 0 in code-point order, null last, without a global window.

    A global sort deals ranges over partitions; the number of rows in each range (one number
    a partition) gives the offsets.
    """
    in_order = scratch.keep(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = sorted((r["p"], r["n"]) for r in in_order.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts = dict(zip((p for p, _ in counts), itertools.accumulate((n for _, n in counts), initial=0), strict=False))
    offset = F.lit(0).cast("long") if not starts else F.element_at(F.create_map(*itertools.chain.from_iterable((F.lit(p), F.lit(n)) for p, n in starts.items())), part)
    return in_order.select("source", "source_size", (offset + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))


def targets(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, target``: all words shared by weight, capped at ``cap`` sizes.

    The level (words per unit of weight) rises as capped sources leave; each step is one
    aggregate over the sources that brings two numbers to the driver.
    """
    by_rank = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = scratch.keep(ranked(sources, scratch).withColumn("w", by_rank))
    limit = F.col("source_size") * cap
    level, free = 0.0, None
    while True:
        over = F.lit(False) if free is None else F.col("w") * F.lit(level) > limit
        total, held, left = weighed.agg(F.sum("source_size"), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("w")))).first()
        if not total or not left or left == free:
            break
        level, free = (total - (held or 0)) / left, left
    return weighed.select("source", "source_size", F.least(F.col("w") * F.lit(float(level)), limit.cast("double")).alias("target"))


def mix(docs: DataFrame, labels: DataFrame | None = None, *, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, source, size, source_size, target, epochs, taken.

    ``labels`` (doc_id, quality) gives quality weights; without it all weigh the same.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), drawn(seed).alias("u"))
    if labels is None:
        rows = rows.withColumn("quality", F.lit(None).cast("int"))
    else:
        rows = rows.join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    key = -F.log(F.col("u")) / quality_weight(F.col("quality"))
    thin = scratch.keep(rows.select("doc_id", "source", "size", "text_hash", key.alias("key")))
    n_bins = max(1, min(MAX_BINS, thin.count() // ROWS_PER_BIN))
    thin = thin.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * n_bins))

    bins = scratch.keep(thin.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    goal = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), scratch, weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = scratch.keep(goal.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))

    upto = Window.partitionBy("source").orderBy("bin")
    sums = bins.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    cut = sums.join(goal, sums["source"].eqNullSafe(goal["source"])).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    cut = cut.select(sums["source"].alias("cut_source"), F.col("bin").alias("cut_bin"), "before")
    plan = scratch.keep(goal.join(cut, goal["source"].eqNullSafe(cut["cut_source"]), "left").drop("cut_source").withColumnRenamed("source", "of"))
    plan = no_bigger(spark, plan, BROADCAST_SOURCES)

    dealt = thin.join(plan, thin["source"].eqNullSafe(plan["of"])).drop("of")
    at_cut = (F.col("bin") == F.col("cut_bin")) & F.col("cut_bin").isNotNull()
    order = Window.partitionBy("source").orderBy("key", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.where(at_cut).withColumn("prefix", F.col("before") + F.sum("size").over(order) - F.col("size"))
    inside = inside.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("prefix")))).drop("prefix")
    # Without a cut bin the rest is all of the source's words, or none of them.
    whole = F.when(F.col("cut_bin").isNull(), F.when(F.col("rest") > 0, F.col("size")).otherwise(F.lit(0))).when(F.col("bin") < F.col("cut_bin"), F.col("size")).otherwise(F.lit(0))
    outside = dealt.where(~at_cut).withColumn("part", whole.cast("long"))
    out = inside.unionByName(outside)
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs") + F.col("part")).alias("taken"))


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` as often as the mix takes each: once an epoch, the last part from half on.

    Rows equal in doc_id and text are dealt by the copy they are, so that each is taken as
    planned. All columns of ``docs`` come back.
    """
    plan = mix(docs, labels, **options)
    copies = (F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    plan = plan.groupBy("doc_id", "text_hash").agg(F.sum(copies).alias("sum"), F.count("*").alias("n"))
    # Rows that repeat take equal shares, rounded up, of what they take together.
    plan = plan.withColumn("copies", F.ceil(F.col("sum") / F.col("n")).cast("int")).where("copies > 0").select("doc_id", "text_hash", "copies")
    # The documents' own columns travel in a struct, so that no name can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    out = rows.join(plan, rows["id"].eqNullSafe(plan["doc_id"]) & (rows["hash"] == plan["text_hash"]))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")
