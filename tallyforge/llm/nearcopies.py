"""SimHash near-duplicates at a Jaccard similarity, by multi-index hashing of wide fingerprints.

At a similarity of 0.8 two 64-bit fingerprints differ in some ten bits, too many for a ball
around them. So each distinct 64-bit shingle hash is grown to ``WORDS`` words, whose majority is a
fingerprint of 1,024 bits, cut into 32 segments of 32 bits. The bits of a segment whose majority is
narrowest are the ones that an edit turns; the ``SOFT`` narrowest span the small Hamming ball
under whose 16 members a fingerprint is entered in the segment's table. Two fingerprints meet in
a table if their segments differ in no bit that is firm in both. What meets is verified on the
complete distance (``DISTANCE``), then on the sets of shingles, so nothing under ``similarity``
is linked.

Equal sets of shingles are one class from the start, so exact copies never meet each other;
equal fingerprints of different sets are verified like any other pair. The rest goes in steps:

* In the first ``FIRST`` tables each entry of a bucket is paired with one leader only. What is not
  far from its leader (``FAMILY``) is of one family with it: pairs linear in their number.
* All pairs of a family are compared, in blocks of ``BLOCK``, each pair of blocks a group of rows.
  A pair is verified within the task unless its ends are joined there already, nearest first, so
  what leaves a task are links linear in its rows. A family of more than ``LARGEST`` classes is
  not compared whole: its leaders' pairs are verified, and what they join is one root.
* Then ``ROUND`` tables at a time, every pair of a bucket is compared whose families (or roots)
  differ. No bucket is cut short. What travels is members of buckets with their sets, not pairs;
  buckets of more than ``BLOCK`` members are dealt out as pairs of blocks. A pair meets in one
  bucket of a table only: the one whose key has zeros where both are soft.

Defined cases: null, empty and blank texts are one class; texts of fewer words than a shingle
have their whole sequence for a shingle; rows that repeat share a component; an empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow
from .components import connected_components, find
from .simhash import SEED, components_of, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
WORDS = 16
#: Complete distance up to which a pair is verified; 155 bits are expected at similarity 0.8.
DISTANCE = 195
#: Complete distance up to which a class belongs to its leader's family; unrelated texts are 512 apart.
FAMILY = 256
#: Complete distance up to which a pair with a leader is verified in a large family.
SURE = 152
#: Classes of a family that is compared whole, at most.
LARGEST = 4096
#: Distance in 64 other bits up to which a pair of a bucket is looked at further; 10 are expected at similarity 0.8.
GLANCE = 20
#: The same for pairs with a leader, at the distance of a family.
WIDE_GLANCE = 26
SOFT = 4
FIRST = 4
ROUND = 8
#: Leaders that each bucket tries in the first round.
LEADERS = 3
#: Entries of one part of a table, all together.
PART_BYTES = 12 << 20
#: Fingerprints whose balls are written together.
FLUSH = 4096
#: Pairs compared at a time.
CHUNK = 1 << 17
#: Members of a bucket up to which only those that have a partner are sent on; of fuller ones all are.
LOOK = 8192
#: Members of a bucket that are compared in one go.
BLOCK = 256

SEGMENTS = 2 * WORDS
BALL = 1 << SOFT
ENTRY = np.dtype([("key", "<u4"), ("soft", "<u4"), ("root", "<u4"), ("id", "<i8"), ("check", "<u8")])
STEPS = np.arange(1, WORDS + 1, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit moves every output bit."""
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def wide_fingerprint(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """The majority of the grown distinct hashes, bit by bit (zero if there are none), and each segment's softest bits."""
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # 255 ones fit a byte
        grown = mixed(hashes[at : at + 255, None] + STEPS)
        ones += np.unpackbits(grown.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    margin = np.abs(2 * ones - len(hashes)).reshape(SEGMENTS, 32)
    soft = np.zeros((SEGMENTS, 32), dtype=np.uint8)
    np.put_along_axis(soft, np.argsort(margin, axis=1, kind="stable")[:, :SOFT], 1, axis=1)
    packed = lambda bits: np.packbits(bits, bitorder="little").tobytes()
    return packed(2 * ones > len(hashes)), packed(soft)


def wide_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """One row per row of ``docs``; ``id`` is a hash of its set of shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)]
        prints = [wide_fingerprint(s) for s in sets]
        ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype="<u8").view("<i8")
        columns = [batch.column(0), batch.column(2), pa.array(ids), pa.array([p for p, _ in prints], pa.binary()), pa.array([s for _, s in prints], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "id", "fp", "soft"])

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, f"doc_id {kind}, text_hash long, id long, fp binary, soft binary")


def words_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, WORDS)


def ball(segment: np.ndarray, soft: np.ndarray) -> np.ndarray:
    """For each segment its value under every setting of its soft bits."""
    out = (segment & ~soft)[:, None]
    left = soft.copy()
    for _ in range(SOFT):
        bit = left & (~left + np.uint32(1))
        out = np.concatenate([out, out | bit[:, None]], axis=1)
        left ^= bit
    return out


def entries(classes: DataFrame, tables: range, parts: int) -> DataFrame:
    """The tables of some segments in ``parts`` parts each: part number and packed entries. ``classes``: id, root, fp, soft."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FLUSH):
                some = batch.slice(at, FLUSH)
                words, softs = words_of(some.column(2)), words_of(some.column(3)).view("<u4")
                root = (mixed(some.column(1).to_numpy().view("<u8")) >> np.uint64(32)).astype("<u4")
                for t in tables:
                    made = np.empty((some.num_rows, BALL), dtype=ENTRY)
                    made["key"] = ball(words.view("<u4")[:, t], softs[:, t])
                    made["soft"], made["root"] = softs[:, t, None], root[:, None]
                    made["id"], made["check"] = some.column(0).to_numpy()[:, None], words[:, (t // 2 + WORDS // 2) % WORDS, None]
                    made = made.ravel()
                    part = (made["key"] * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(parts)
                    made = made[np.argsort(part, kind="stable")]
                    counts = np.bincount(part, minlength=parts)
                    ends, used = np.cumsum(counts), np.flatnonzero(counts)
                    blobs = [made[ends[p] - counts[p] : ends[p]].tobytes() for p in used]
                    yield pa.RecordBatch.from_arrays([pa.array((used + t * parts).astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "packed"])

    made = classes.select("id", "root", "fp", "soft").mapInArrow(run, "part int, packed binary")
    return made.repartition("part").sortWithinPartitions("part")


def by_part(f: Callable[[int, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` of each part number and its entries; rows come ordered by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packed = None, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now:
                    if packed:
                        yield f(now, np.frombuffer(b"".join(packed), dtype=ENTRY))
                    now, packed = part, []
                packed.append(blob)
        if packed:
            yield f(now, np.frombuffer(b"".join(packed), dtype=ENTRY))

    return run


def runs(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows the end of each row's run of equal keys."""
    n = len(keys[0])
    begins = np.zeros(n, dtype=bool)
    begins[:1] = True
    for k in keys:
        begins[1:] |= k[1:] != k[:-1]
    ends = np.r_[np.flatnonzero(begins)[1:], n]
    return np.repeat(ends, np.diff(np.r_[0, ends])) if n else np.zeros(0, dtype=np.int64)


def near(table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(table["check"][i] ^ table["check"][j])


def leaders(part: int, table: np.ndarray) -> pa.RecordBatch:
    """Of each entry that is near a leader of its bucket the pair with the nearest one in this part."""
    table = table[np.lexsort((table["id"], table["key"]))]
    end = runs(table["key"])
    left = np.arange(len(table))
    found = []
    for _ in range(LEADERS):
        first = np.searchsorted(end[left], end[left])
        shared = np.bincount(first, minlength=len(left))[first] > 1
        first, left = left[first[shared]], left[shared]
        apart = near(table, first, left)
        ok = (apart <= WIDE_GLANCE) & (first != left)
        found.append((table["id"][first[ok]], table["id"][left[ok]], apart[ok]))
        left = left[(apart > WIDE_GLANCE) & (first != left)]
    a, b, apart = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((a, apart, b))
    a, b = a[order], b[order]
    best = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, dtype=bool)
    return pa.RecordBatch.from_arrays([pa.array(a[best]), pa.array(b[best])], ["a", "b"])


def crossing(end: np.ndarray, after: np.ndarray, looked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket (ending at ``end``) and different roots (a root's run ends at ``after``)."""
    i = np.flatnonzero(looked & (after < end))
    step = 0
    while len(i):
        for at in range(0, len(i), CHUNK):
            some = i[at : at + CHUNK]
            yield some, after[some] + step
        step += 1
        i = i[after[i] + step < end[i]]


def members(parts: int) -> Callable[[int, np.ndarray], pa.RecordBatch]:
    """Members of buckets with a near one of another root, by bucket and pair of blocks."""

    def run(part: int, table: np.ndarray) -> pa.RecordBatch:
        table = table[np.lexsort((table["id"], table["root"], table["key"]))]
        end, after = runs(table["key"]), runs(table["key"], table["root"])
        # Where the first root's run ends with the bucket there is nothing to compare.
        several = after[np.searchsorted(end, end)] < end
        table = table[several]
        end, after = runs(table["key"]), runs(table["key"], table["root"])
        chosen = end - np.searchsorted(end, end) > LOOK
        for i, j in crossing(end, after, ~chosen):
            ok = (table["key"][i] & table["soft"][i] & table["soft"][j] == 0) & (near(table, i, j) <= GLANCE)
            chosen[i[ok]] = chosen[j[ok]] = True
        table = table[chosen]
        end = runs(table["key"])
        start = np.searchsorted(end, end)
        n_blocks = -(-(end - start) // BLOCK)
        own = (np.arange(len(table)) - start) // BLOCK
        at = np.repeat(np.arange(len(table)), n_blocks)
        other = np.arange(len(at)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        pair = np.minimum(own[at], other) * n_blocks[at] + np.maximum(own[at], other)
        bucket = (part // parts << 32) | table["key"].astype(np.int64)
        columns = [bucket[at], pair.astype(np.int32), own[at].astype(np.int32), table["soft"].astype(np.int64)[at], table["id"][at]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "pair", "own", "soft", "id"])

    return run


def compared(rows: pa.Table, similarity: float) -> pa.RecordBatch:
    """Links between the roots of whole buckets (rows ordered by bucket, pair of blocks and root).

    Near pairs of different roots are verified on their sets, nearest first, until the roots are joined.
    """
    bucket, pair, own, soft, ident, root = (rows.column(k).to_numpy() for k in range(6))
    words, packed = words_of(rows.column(6)), rows.column(7).chunk(0)
    end, after = runs(bucket, pair), runs(bucket, pair, root)
    begins = np.unique(np.searchsorted(end, end))
    across = np.repeat(np.maximum.reduceat(own, begins) != np.minimum.reduceat(own, begins), np.diff(np.r_[begins, len(own)]))
    close = [np.zeros((3, 0), dtype=np.int64)]
    for i, j in crossing(end, after, np.ones(len(end), dtype=bool)):
        ok = (bucket[i] & soft[i] & soft[j] == 0) & (~across[i] | (own[i] != own[j]))
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
        close.append(np.stack([apart, i, j])[:, apart <= DISTANCE])
    close = np.concatenate(close, axis=1)
    known: dict[int, np.ndarray] = {}
    up: dict[int, int] = {}
    a, b = [], []
    failed: set[tuple[int, int]] = set()
    for i, j in close[1:, np.argsort(close[0], kind="stable")].T.tolist():
        x, y = find(up, int(root[i])), find(up, int(root[j]))
        key = (int(ident[i]), int(ident[j]))
        if x == y or key in failed:
            continue
        one, two = (known.setdefault(k, np.frombuffer(packed[k].as_buffer(), dtype="<u8")) for k in (i, j))
        if min(len(one), len(two)) < similarity * max(len(one), len(two)):
            continue
        common = len(np.intersect1d(one, two, assume_unique=True))
        if common >= similarity * (len(one) + len(two) - common):
            up[max(x, y)] = min(x, y)
            a.append(key[0])
            b.append(key[1])
        else:
            failed.add(key)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def bucketwise(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``compared`` of whole buckets, a batch or so at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            bucket, pair = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            begins = np.flatnonzero((bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])) + 1
            if batch.num_rows and last not in (None, (bucket[0], pair[0])):
                begins = np.r_[0, begins]
            if len(begins):
                yield compared(pa.Table.from_batches([*held, batch.slice(0, begins[-1])]).combine_chunks(), similarity)
                held, batch = [], batch.slice(begins[-1])
            if batch.num_rows:
                held.append(batch)
                last = bucket[-1], pair[-1]
        if held:
            yield compared(pa.Table.from_batches(held).combine_chunks(), similarity)

    return run


def within(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The pairs of a batch that belong to one family, with their distance."""
    apart = np.bitwise_count(words_of(batch.column(2)) ^ words_of(batch.column(3))).sum(axis=1, dtype=np.int32)
    close = pa.array(apart <= FAMILY)
    return pa.RecordBatch.from_arrays([c.filter(close) for c in (batch.column(0), batch.column(1), pa.array(apart))], ["a", "b", "apart"])


def shingle_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``id`` and the set of shingle hashes, packed, of those ``classes`` that are in ``wanted`` (id)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    some = classes.join(wanted, "id", "left_semi").select("id", "rep_hash")
    # One plan at every size: the wanted rows may be too many to broadcast.
    texts = docs.select("text", F.xxhash64("text").alias("rep_hash")).join(some.hint("merge"), "rep_hash")
    return map_arrow(texts.dropDuplicates(["id"]).select("id", "text"), run, "id long, shingles binary")


def alike(similarity: float) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """The pairs (a, b, and the set of each) that have the similarity."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            one, two = (np.frombuffer(c.as_buffer(), dtype="<u8") for c in (x, y))
            common = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(common >= similarity * (len(one) + len(two) - common))
        kept = pa.array(keep, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    return run


def links(docs: DataFrame, classes: DataFrame, scratch: Scratch, shingle: int, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of the classes whose shingle sets have the similarity, but for such as others connect."""
    parts = max(16, -(-classes.count() * BALL * ENTRY.itemsize // PART_BYTES))

    def sided(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
        side = lambda c: of.select(F.col("id").alias(c), F.col(column).alias(f"{c}_{column}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", f"a_{column}", f"b_{column}")

    def verified(met: DataFrame, sets: DataFrame) -> DataFrame:
        """Links of the members of buckets (bucket, pair, own, soft, id) by their sets (id, root, fp, shingles)."""
        dealt = met.join(sets, "id").select("bucket", "pair", "own", "soft", "id", "root", "fp", "shingles")
        dealt = dealt.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "root")
        return scratch.keep(dealt.mapInArrow(bucketwise(similarity), "a long, b long"))

    alone = classes.withColumn("root", F.col("id"))
    led = entries(alone, range(FIRST), parts).mapInArrow(by_part(leaders), "a long, b long").distinct()
    led = scratch.keep(map_arrow(sided(led, classes, "fp"), within, "a long, b long, apart int"))
    families = connected_components(led.select("a", "b"), scratch).withColumnRenamed("node", "id")
    families = scratch.keep(families.join(families.groupBy("root").agg(F.count("*").alias("n")), "root"))
    whole, large = families.where(F.col("n") <= LARGEST), families.where(F.col("n") > LARGEST)

    sets = scratch.keep(shingle_sets(docs, classes, families.select("id"), shingle))
    # A member goes to its block's pair with every block of the family.
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    blocks = whole.select("id", F.col("root").alias("bucket"), n_blocks.alias("blocks"), F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("own"))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    met = blocks.select("bucket", pair.cast("int").alias("pair"), "own", F.lit(0).cast("long").alias("soft"), "id")
    joined = verified(met, sets.join(alone.select("id", "root", "fp"), "id"))
    roots = whole.select("id", "root")
    if not large.isEmpty():
        sure = led.where(F.col("apart") <= SURE).join(large.select(F.col("id").alias("a")), "a", "left_semi")
        more = scratch.keep(map_arrow(sided(sure, sets, "shingles"), alike(similarity), "a long, b long"))
        joined = joined.unionAll(more)
        roots = roots.unionAll(connected_components(more, scratch).select(F.col("node").alias("id"), "root"))
    scratch.drop(led, sets)
    rooted = scratch.keep(classes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "fp", "soft"))
    rounds, found = [], joined
    for t in range(0, SEGMENTS, ROUND):
        met = entries(rooted, range(t, min(t + ROUND, SEGMENTS)), parts).mapInArrow(by_part(members(parts)), "bucket long, pair int, own int, soft long, id long")
        rounds.append(scratch.keep(met))
    ids = rounds[0].select("id")
    for met in rounds[1:]:
        ids = ids.unionAll(met.select("id"))
    sets = scratch.keep(shingle_sets(docs, classes, ids.distinct(), shingle).join(rooted.drop("soft"), "id"))
    for met in rounds:
        found = found.unionAll(verified(met, sets))
    scratch.drop(rooted, sets, *rounds)
    return found


def near_copies(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, component_id (least doc_id reachable)."""
    scratch = Scratch(docs.sparkSession, "nearcopies")
    rows = scratch.keep(wide_fingerprints(docs, shingle))
    classes = rows.groupBy("id").agg(F.min("doc_id").alias("rep"), F.min("text_hash").alias("rep_hash"), F.min("fp").alias("fp"), F.min("soft").alias("soft"))
    classes = scratch.keep(classes)
    named = components_of(classes, "id", links(docs, classes, scratch, shingle, similarity), scratch)
    found = scratch.keep(rows.join(named, "id").select("doc_id", "text_hash", "component_id"))
    scratch.drop(rows, classes)
    return found
