"""SimHash near-duplicates by multi-index hashing.

Fingerprints are made in Python batches (XXH64 of word shingles, bitwise majority in
numpy); everything after that is DataFrame work over the distinct fingerprints, so exact
copies never meet each other.

Two fingerprints at distance two or less either agree in one 32-bit half, or differ in one
bit of each. Both cases are found in tables keyed on a half and a further segment:

* ball of radius 0 in one half: the other half differs in two bits at most, so one of its
  three segments (11, 11 and 10 bits) is equal and joins the key;
* ball of radius 1 in the high half: of such a pair one fingerprint has the differing bit
  set and enumerates the ball by clearing each of its set bits; the low half differs in one
  bit, so one of its two 16-bit segments is equal and joins the key.

What the tables return is verified on the whole fingerprint. A key with over ``HOT_KEY``
fingerprints is not paired up: its fingerprints enumerate their whole ball (2,080
neighbours) and look these up exactly, which is linear in their number.

Defined cases: null, empty and blank texts have fingerprint 0 and link like any other; rows
that repeat share a component; an empty table gives no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, map_arrow
from .components import connected_components

SHINGLE = 3
SEED = 42
DISTANCE = 2
HOT_KEY = 1024
MASK32 = 0xFFFFFFFF


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; of all its words where they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = ends[shingle - 1 :] or ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts, last, strict=False)], dtype="<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        some = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the text's hash and the fingerprint (signed longs), one row per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype="<u8").view("<i8")
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints)], ["doc_id", "text_hash", "fp"])

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, f"doc_id {kind}, text_hash long, fp long")


def bits(c: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(c, shift).bitwiseAND((1 << width) - 1)


def near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def packed(tag: int, half: Column, segment: Column) -> Column:
    """Table, 32-bit half and segment in one long: 4 + 32 + 16 bits."""
    return F.lit(tag << 48).cast("long").bitwiseOR(F.shiftleft(half, 16)).bitwiseOR(segment)


def tables(fp: Column) -> list[Column]:
    """Keys of radius 0: for each half, the half and each of three segments of the other."""
    high, low = bits(fp, 32, 32), bits(fp, 0, 32)
    cuts = ((0, 11), (11, 11), (22, 10))
    return [packed(3 * i + j, same, bits(other, *cut)) for i, (same, other) in enumerate(((high, low), (low, high))) for j, cut in enumerate(cuts)]


def links(prints: DataFrame, scratch: Scratch, hot_key: int = HOT_KEY) -> DataFrame:
    """Pairs ``a, b`` of the distinct longs ``fp`` at distance two or less; pairs may repeat."""
    fp = F.col("fp")
    same = prints.select(fp, F.explode(F.array(*tables(fp))).alias("key"))
    high, low = bits(fp, 32, 32), bits(fp, 0, 32)
    table = prints.select(fp, F.explode(F.array(*[packed(8 + j, high, bits(low, 16 * j, 16)) for j in (0, 1)])).alias("key"))
    set_bits = F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(32)]), lambda m: high.bitwiseAND(m) != 0)
    cleared = prints.select(fp, F.explode(set_bits).alias("bit")).select(fp, high.bitwiseXOR(F.col("bit")).alias("half"), low.alias("low"))
    probe = cleared.select(fp, F.explode(F.array(*[packed(8 + j, F.col("half"), bits(F.col("low"), 16 * j, 16)) for j in (0, 1)])).alias("key"))

    hot = scratch.keep(same.unionAll(table).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_key).select("key"))
    spread = hot.count() > 0
    if spread:
        in_hot = same.unionAll(table).join(hot, "key", "left_semi").select("fp").distinct()
        same, table, probe = (x.join(hot, "key", "left_anti") for x in (same, table, probe))
    renamed = lambda x, name: x.select("key", fp.alias(name))
    pairs = renamed(same, "a").join(renamed(same, "b"), "key").where((F.col("a") < F.col("b")) & near(F.col("a"), F.col("b"))).select("a", "b")
    pairs = pairs.unionAll(renamed(probe, "a").join(renamed(table, "b"), "key").where(near(F.col("a"), F.col("b"))).select("a", "b"))
    if spread:
        one = [1 << i for i in range(64)]
        flips = [m - (1 << 64) if m >> 63 else m for m in [*one, *(x | y for i, x in enumerate(one) for y in one[:i])]]
        ball = in_hot.select(fp.alias("a"), F.explode(F.array(*[F.lit(m).cast("long") for m in flips])).alias("m")).select("a", F.col("a").bitwiseXOR(F.col("m")).alias("fp"))
        pairs = pairs.unionAll(ball.join(prints.select("fp"), "fp").select("a", fp.alias("b")))
    return pairs


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, hot_key: int = HOT_KEY) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fp (signed long),
    component_id (least doc_id reachable)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, shingle))
    classes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    named = components_of(classes, "fp", links(classes.select("fp"), scratch, hot_key), scratch)
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def components_of(classes: DataFrame, node: str, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and component_id, the least ``rep`` that it reaches, for every row of ``classes``."""
    roots = connected_components(edges, scratch)
    joined = scratch.keep(classes.select(node, "rep").join(roots.withColumnRenamed("node", node), node, "left"))
    least = scratch.keep(joined.where("root is not null").groupBy("root").agg(F.min("rep").alias("least")))
    return scratch.keep(joined.join(least, "root", "left").select(node, F.coalesce("least", "rep").alias("component_id")))


def deduplicated(docs: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row for each component: that of the least doc_id.

    ``components`` has doc_id, text_hash and component_id; ``near_duplicates`` makes it if not given.

    Of several rows with this doc_id the one of least text hash stays, once. Only the rows
    to go are joined with the texts, and few of them travel as a broadcast.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    found = scratch.keep(near_duplicates(docs) if components is None else components)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    stay = found.where(first).groupBy("component_id").agg(F.min("text_hash").alias("_least"), F.count("*").alias("n"))
    again = scratch.keep(stay.where("n > 1").select(F.col("component_id").alias("_again"), "_least"))
    gone = found.where(~first).select("doc_id", "text_hash")
    repeats = again.count() > 0
    if repeats:
        more = found.where(first).join(again, F.col("doc_id").eqNullSafe(F.col("_again"))).where("text_hash <> _least")
        gone = gone.unionAll(more.select("doc_id", "text_hash"))
    gone = scratch.keep(gone.distinct().select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"]), "left_anti")
    if repeats:
        same = kept["doc_id"].eqNullSafe(again["_again"])
        kept = kept.join(again, same, "left_anti").unionAll(kept.join(again, same, "left_semi").dropDuplicates(["doc_id"]))
    return kept


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
