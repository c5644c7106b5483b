"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``WINDOW`` consecutive words of a benchmark item, or the whole item if that is
shorter. For a window length ``L`` the fingerprints of a text are the hashes of its k-grams
(k = L // 2) that are least in some run of L - k + 1 consecutive k-grams, leftmost on ties.
A shared window has the same least k-gram on both sides, so every occurrence of a window
meets a fingerprint of its item at the same place. Each hit carries the words around it and
is extended to both sides; it counts if the shared span reaches L words.

All work on a text happens in one expression over arrays, in the scan's stage. The
benchmark's fingerprints are broadcast up to ``BROADCAST_ROWS`` rows, beyond that the join
is left to shuffle. A document's own row travels along as a marker, so texts are read once.

Defined cases: null, empty and wordless texts have no words and no hits; such items have no
windows; an item without id marks words but cannot be listed; rows that repeat get equal
results; an empty benchmark contaminates nothing. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, no_bigger, read

WINDOW = 13
#: A document is contaminated if one word in this many is hit.
SHARE = 20
BROADCAST_ROWS = 200_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Low bits of a k-gram hash that give way to its place, so that the least long is leftmost.
PLACE = (1 << 24) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def lowered(text: Column) -> Column:
    """A-Z in lower case; ``lower`` does the same, and faster, where all is ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def word_hashes(text: Column) -> Column:
    """The 64-bit hashes of a text's words in order."""

    def inner(parts: Column) -> Column:
        skip = F.when(parts[0] == "", 1).otherwise(0)
        tail = F.when((F.size(parts) > skip) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        return F.transform(F.slice(parts, skip + 1, F.size(parts) - skip - tail), lambda w: F.xxhash64(w))

    return let(F.split(lowered(F.coalesce(text, F.lit(""))), NOT_WORD), inner)


def gram(length: int) -> int:
    return max(1, length // 2)


def winnowed(words: Column, length: int) -> Column:
    """Fingerprints for windows of ``length``: array of (len, hash, pos, context).

    ``context`` is the k-gram with ``length - k`` words on both sides, less where the text ends.
    """
    k = gram(length)
    run, n = length - k + 1, F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.slice(words, i + 1, k)).bitwiseAND(~PLACE).bitwiseOR(i.bitwiseAND(PLACE)))

    def chosen(g: Column) -> Column:
        places = F.transform(F.sequence(F.lit(0), n - length), lambda j: j + (F.array_min(F.slice(g, j + 1, run)) - j).bitwiseAND(PLACE).cast("int"))
        moved = let(places, lambda p: F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1))))
        before = lambda p: F.least(p, F.lit(length - k))
        one = lambda p: F.struct(F.lit(length).alias("len"), F.shiftright(F.get(g, p), 24).alias("hash"), p.alias("pos"), F.slice(words, p - before(p) + 1, before(p) + length).alias("context"))
        return F.transform(moved, one)

    none = F.array().cast("array<struct<len:int,hash:bigint,pos:int,context:array<bigint>>>")
    return F.when(n >= length, let(grams, chosen)).otherwise(none)


def marked(words: Column, lengths: list[int], own: Column) -> Column:
    """A marker (len 0, pos the number of words), then the fingerprints for all lengths."""
    marker = F.array(F.struct(F.lit(0).alias("len"), own.alias("hash"), F.size(words).alias("pos"), F.array().cast("array<bigint>").alias("context")))
    return F.concat(marker, *[winnowed(words, n) for n in lengths])


def shared(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(first == 0, F.size(F.zip_with(a, b, lambda x, y: x))).otherwise(first - 1).cast("int")


def covered(spans: Column) -> Column:
    """Words in the union of sorted (start, end) spans, ends exclusive."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["to"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to"))
    return F.aggregate(spans, zero, step, lambda s: s["n"]).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, n_hit, spans, items, contaminated.

    ``spans`` are the hit stretches found (start, end in words), ``items`` the item ids as
    sorted strings.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), word_hashes(F.col("text")).alias("words")).where(F.size("words") > 0)
    # Items of equal words hit together, once.
    items = scratch.keep(items.groupBy("words").agg(F.collect_set("item_id").alias("ids")))
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(window))).distinct().collect())
    prints = None
    for n in lengths:
        some = items.where(F.least(F.size("words"), F.lit(window)) == n).select("ids", F.explode(winnowed(F.col("words"), n)).alias("f"))
        prints = some if prints is None else prints.unionAll(some)
    if prints is None:
        prints = items.select("ids", F.explode(winnowed(F.col("words"), window)).alias("f"))
    prints = scratch.keep(prints.select("ids", F.col("f.len").alias("len"), F.col("f.hash").alias("hash"), F.col("f.pos").alias("at"), F.col("f.context").alias("item")))
    prints = no_bigger(spark, prints, BROADCAST_ROWS)

    # The text is hashed in a select of its own, so that it is gone before there is a row for each fingerprint.
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), let(word_hashes(F.col("text")), lambda w: marked(w, lengths, F.xxhash64("doc_id", "text"))).alias("fs"))
    # No array is empty, so this is a plain explode, but one for which the optimizer adds no filter that makes the array twice.
    found = found.select("doc_id", "text_hash", F.explode_outer("fs").alias("f"))
    found = found.select("doc_id", "text_hash", F.col("f.len").alias("len"), F.col("f.hash").alias("hash"), F.col("f.pos").alias("pos"), F.col("f.context").alias("context"))
    hits = found.join(prints, ["len", "hash"], "left").where((F.col("len") == 0) | F.col("at").isNotNull())

    k = F.greatest(F.lit(1), F.floor(F.col("len") / 2).cast("int"))
    side = F.col("len") - k
    halves = {}
    for name, context, place in (("d", "context", "pos"), ("i", "item", "at")):
        before = F.least(F.col(place), side)
        halves[name] = F.reverse(F.slice(context, 1, before)), F.slice(context, before + 1, F.col("len"))
    left = shared(halves["d"][0], halves["i"][0])
    right = shared(halves["d"][1], halves["i"][1])
    real = F.col("len") > 0
    hits = hits.withColumn("left", F.when(real, left)).withColumn("right", F.when(real, right)).where((F.col("len") == 0) | (F.col("left") + F.col("right") >= F.col("len")))
    span = F.when(real, F.struct((F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end")))
    by_doc = hits.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(~real, F.col("pos"))).cast("long").alias("n_words"),
        F.sum(F.when(~real, 1)).alias("copies"),
        F.sort_array(F.collect_set(span)).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
    )
    by_doc = by_doc.withColumn("n_hit", covered(F.col("spans")))
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    # Rows that repeat were counted together and come apart again.
    out = by_doc.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "text_hash", "n_words", "n_hit", "spans", "items", bad.alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they are."""
    scratch = Scratch(docs.sparkSession, "decontaminated")
    found = contamination(docs, benchmark, **options).where("contaminated")
    bad = scratch.keep(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"]), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")
