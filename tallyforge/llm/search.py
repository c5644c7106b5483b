"""Ranked lexical search over a clustered index with exact stopping.

Recursive graph bisection orders documents so that those with the same terms stand together: a set
of documents is halved, and pairs swap sides for as long as that lowers the bits which the gaps of the
two halves' posting lists cost. It is fitted on at most ``SAMPLE`` documents, whose terms
are hashed to ``BUCKETS``; what it learns, the price of each term on either side of each cut, sends every
document of the table down the tree. The index has a row a document (shard, doc_id, n, terms, tfs),
ordered by shard in every file, a shard being what one task found for one cluster, and for each
shard its terms with the number of documents and the largest share of the term's weight that one gets.
Terms are kept in one string a row and numbers in one binary value, which Spark passes on as they are.

A query's bound for a shard is the sum of its terms' weights times these shares: no document in the
shard scores more. Shards are visited in three rounds, by falling bound: the first 1/16, up to 1/4, the
rest. After each round a shard whose bound is below the score of the query's last place is never read;
one whose bound equals it is, since equal scores go by doc_id. So results are exact. A task scores
the documents it visits for all queries of a block by sums over posting lists and returns the
``k`` best of each batch. Nothing but the queries' terms (``BLOCK_TERMS`` at most in a block) and their
best scores so far goes to the driver.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are
lower-cased. Arithmetic is in 64-bit integers but for the logarithm.

Defined cases: null and empty texts have no terms, count for nothing and are never found; texts are
read whole, whatever their length; rows that repeat are documents of their own; equal scores go by
doc_id, documents without one last; queries that repeat are answered each; queries without a term,
or with none that occurs, give no rows, and so does an empty table. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, no_bigger, read, texts_of

K = 50
#: Documents that the bisection is fitted on at most, and how many hashed terms of each.
SAMPLE = 2_048
SAMPLE_TERMS = 1_000
BUCKETS = 1 << 13
DEPTH = 5
SWEEPS = 12
#: Terms of one block of queries.
BLOCK_TERMS = 50_000
BLOCK_QUERIES = 256
#: Parts of a query's shards, by falling bound, up to which the rounds visit.
ROUNDS = (1 / 16, 1 / 4, 1.0)
#: Rows of a table that is broadcast, if it has no more.
BROADCAST_ROWS = 20_000
#: Rows and characters that one Arrow batch is cut into.
BATCH_ROWS = 1_000

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, in UTF-8; a byte beyond ASCII is part of a character beyond it."""
    return TERM.findall(text.encode().lower())


def bucket(term: bytes) -> int:
    return crc32(term) % BUCKETS


# -- recursive graph bisection -------------------------------------------------------------------------------------


def price(degree: np.ndarray, n: int) -> np.ndarray:
    """Bits that posting lists of these degrees cost in a half of n documents."""
    return degree * np.log2(n / (degree + 1.0))


@dataclass
class Cuts:
    """For each inner node of the tree the price of a bucket on the left less that on the right, and the cut."""

    weight: np.ndarray
    cut: np.ndarray

    def leaves(self, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """The cluster of each of n documents; ``flat`` has their buckets, ``owner`` whose they are."""
        node = np.zeros(n, dtype=np.int64)
        for _ in range(DEPTH):
            lean = np.bincount(owner, weights=self.weight[node[owner], flat], minlength=n)
            node = 2 * node + 1 + (lean > self.cut[node])
        return node - (2**DEPTH - 1)


def halves(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Which side each of n documents is on after swaps; true is right."""
    right = np.arange(n) >= n // 2
    for _ in range(SWEEPS):
        sides = right[owner]
        d = [np.bincount(flat[sides == s], minlength=BUCKETS).astype(float) for s in (False, True)]
        size = [n - int(right.sum()), int(right.sum())]
        old = price(d[0], size[0]) + price(d[1], size[1])
        # What a document's terms gain by its leaving a side.
        gain = [old - price(np.maximum(d[s] - 1, 0), size[s]) - price(d[1 - s] + 1, size[1 - s]) for s in (0, 1)]
        moved = np.bincount(owner, weights=np.where(sides, gain[1][flat], gain[0][flat]), minlength=n)
        order = [np.flatnonzero(right == s)[np.argsort(-moved[right == s], kind="stable")] for s in (False, True)]
        m = min(map(len, order))
        swap = moved[order[0][:m]] + moved[order[1][:m]] > 1e-9
        if not swap.any():
            break
        right[order[0][:m][swap]], right[order[1][:m][swap]] = True, False
    return right


def bisected(sample: list[np.ndarray]) -> Cuts:
    """The tree fitted on the buckets of sampled documents."""
    inner = 2**DEPTH - 1
    cuts = Cuts(np.zeros((inner, BUCKETS), dtype=np.float32), np.zeros(inner))
    members = {0: np.arange(len(sample))}
    for node in range(inner):
        mine = members.pop(node, np.empty(0, dtype=np.int64))
        left, right = mine, mine[:0]
        if len(mine) >= 2:
            flat = np.concatenate([sample[i] for i in mine])
            owner = np.repeat(np.arange(len(mine)), [len(sample[i]) for i in mine])
            side = halves(flat, owner, len(mine))
            d = [np.bincount(flat[side[owner] == s], minlength=BUCKETS) for s in (False, True)]
            cuts.weight[node] = np.log2((d[1] + 1) / side.sum()) - np.log2((d[0] + 1) / (~side).sum())
            lean = np.bincount(owner, weights=cuts.weight[node, flat], minlength=len(mine))
            cuts.cut[node] = np.median(lean)
            over = lean > cuts.cut[node]
            left, right = mine[~over], mine[over]
        members[2 * node + 1], members[2 * node + 2] = left, right
    return cuts


def sampled(docs: DataFrame) -> list[np.ndarray]:
    """Buckets of the terms of at most ``SAMPLE`` documents, those of least hash; ``SAMPLE_TERMS`` buckets of each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(sorted({bucket(t) for t in terms_of(x)}), dtype=np.uint16) for x in texts_of(batch)]
            rows = [r[:: len(r) // SAMPLE_TERMS + 1].tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["buckets"])

    keyed = docs.select("text", F.xxhash64("doc_id", "text").alias("_key")).where(F.length("text") > 0)
    last = keyed.select("_key").orderBy("_key").limit(SAMPLE).agg(F.max("_key")).first()[0]
    # A row that repeats can stand at the last place many times.
    found = keyed.where(F.col("_key") <= F.lit(last)).select("text").limit(SAMPLE).mapInArrow(run, "buckets binary").collect()
    return [np.frombuffer(r["buckets"], dtype=np.uint16).astype(np.int64) for r in found if r["buckets"]]


# -- the index -----------------------------------------------------------------------------------------------------


@dataclass
class Index:
    """``rows``: shard, doc_id, n, terms, tfs, a row a document with terms. ``bounds``: shard, terms, dfs, shares.

    A shard that comes in several batches has several rows of bounds; its shares then add up to more than
    the largest, which is a bound as well.
    """

    rows: DataFrame
    bounds: DataFrame
    n_docs: int
    n_terms: int


def length_factor(n, n_docs: int, n_terms: int):
    """m of documents with n terms, in whole numbers."""
    return 100 - 50 + (50 * n * n_docs) // max(n_terms, 1)


def share(tf, m):
    """The share of a term's weight that a document gets, in whole numbers."""
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


def listed(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a column of joined terms, and how many there are in each row."""
    lists = pc.split_pattern(column, " ")
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """32-bit numbers as one binary value a row."""
    ends = np.cumsum(sizes)
    return pa.array([values[b - n : b].tobytes() for b, n in zip(ends, sizes, strict=True)], pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int32)


def build_index(docs: DataFrame) -> Index:
    """The index of the documents, as two stored tables."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(spark, "search")
    cuts = spark.sparkContext.broadcast(bisected(sampled(docs)))  # DEPTH and BUCKETS give its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        known: dict[bytes, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                counts = [Counter(terms_of(x)) for x in texts_of(batch)]
                rows = [i for i, c in enumerate(counts) if c]
                counts = [counts[i] for i in rows]
                sizes = np.array([len(c) for c in counts], dtype=np.int64)
                terms = [t for c in counts for t in c]
                tfs = np.fromiter((v for c in counts for v in c.values()), dtype=np.int32, count=len(terms))
                if len(known) > 500_000:
                    known.clear()
                for t in set(terms).difference(known):
                    known[t] = bucket(t)
                flat = np.fromiter(map(known.__getitem__, terms), dtype=np.int64, count=len(terms))
                leaf = cuts.value.leaves(flat, np.repeat(np.arange(len(rows)), sizes), len(rows)) if rows else np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(task * 2**DEPTH + leaf, pa.int64()), batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([c.total() for c in counts], pa.int64()),
                        pa.array([b" ".join(c) for c in counts], pa.binary()).cast(pa.string()), packed(tfs, sizes),
                    ],
                    ["shard", "doc_id", "n", "terms", "tfs"],
                )

    routed = docs.select("doc_id", "text").mapInArrow(run, f"shard long, doc_id {kind}, n long, terms string, tfs binary")
    rows = scratch.keep(routed.sortWithinPartitions("shard"))
    total = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, sizes = listed(batch.column("terms"))
            m = length_factor(batch.column("n").to_numpy(zero_copy_only=False), n_docs, n_terms)
            part = share(unpacked(batch.column("tfs")).astype(np.int64), np.repeat(m, sizes))
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            found = pa.table({"shard": np.repeat(shards, sizes), "term": terms, "share": part}).group_by(["shard", "term"], use_threads=False).aggregate([("share", "max"), ("share", "count")]).sort_by("shard")
            own, sizes = np.unique(found["shard"].to_numpy(), return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), found["term"].combine_chunks())
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pc.binary_join(lists, " "), packed(found["share_count"].to_numpy().astype(np.int32), sizes), packed(found["share_max"].to_numpy().astype(np.int32), sizes)], ["shard", "terms", "dfs", "shares"]
            )

    bounds = rows.select("shard", "n", "terms", "tfs").mapInArrow(bound, "shard long, terms string, dfs binary, shares binary")
    return Index(rows, scratch.keep(bounds), n_docs, n_terms)


# -- search --------------------------------------------------------------------------------------------------------


def blocks_of(queries: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """Queries (place, terms) in blocks of at most ``BLOCK_QUERIES`` and ``BLOCK_TERMS``, one query at least; streamed from the stored table."""
    block, held = [], 0
    for r in queries.select("_q", "terms").toLocalIterator():
        if block and (len(block) == BLOCK_QUERIES or held + len(r["terms"]) > BLOCK_TERMS):
            yield block
            block, held = [], 0
        block.append((r["_q"], r["terms"]))
        held += len(r["terms"])
    if block:
        yield block


def query_terms(queries: DataFrame) -> DataFrame:
    """_q, item_id, terms: queries with their distinct terms, numbered, those without terms left out."""
    kind = queries.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [[t.decode() for t in sorted(set(terms_of(x)))] for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.string()))], ["item_id", "terms"])

    found = queries.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<string>")
    return Scratch(queries.sparkSession, "queries").keep(found.where(F.size("terms") > 0).withColumn("_q", F.monotonically_increasing_id()))


def best_of(batch: pa.RecordBatch, vocabulary: pa.Array, weights: np.ndarray, lists: list[np.ndarray], floor: np.ndarray, index: tuple[int, int], k: int) -> tuple[list[np.ndarray], ...]:
    """For the queries that visit each row: (query, row, score) of the ``k`` best in this batch."""
    rank = pc.rank(batch.column("doc_id"), null_placement="at_end", tiebreaker="first").to_numpy(zero_copy_only=False)
    terms, sizes = listed(batch.column("terms"))
    owner = np.repeat(np.arange(batch.num_rows), sizes)
    term = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(term >= 0)
    hit = hit[np.argsort(term[hit], kind="stable")]
    term, owner, tf = term[hit], owner[hit], unpacked(batch.column("tfs"))[hit].astype(np.int64)
    m = length_factor(batch.column("n").to_numpy(zero_copy_only=False), *index)
    # Weights are below 2 ** 16 and shares below 2 ** 20, so sums of millions of terms are exact in float64.
    impact = (weights[term] * share(tf, m[owner])).astype(np.float64)
    first = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    visits = batch.column("queries")
    visitor = visits.flatten().to_numpy(zero_copy_only=False)
    visited = np.repeat(np.arange(batch.num_rows), pc.list_value_length(visits).to_numpy(zero_copy_only=False))
    by_query = np.argsort(visitor, kind="stable")
    visitor, visited = visitor[by_query], visited[by_query]
    out: tuple[list[np.ndarray], ...] = ([], [], [])
    for q in np.unique(visitor):
        rows = visited[np.searchsorted(visitor, q) : np.searchsorted(visitor, q, side="right")]
        slices = [slice(first[t], first[t + 1]) for t in lists[q] if first[t] < first[t + 1]]
        if not slices:
            continue
        at = np.concatenate([owner[s] for s in slices])
        scores = np.bincount(at, weights=np.concatenate([impact[s] for s in slices]), minlength=batch.num_rows)[rows]
        good = scores >= max(floor[q], 1)
        rows, scores = rows[good], scores[good]
        if len(rows) > k:
            order = np.lexsort((rank[rows], -scores))[:k]
            rows, scores = rows[order], scores[order]
        for store, x in zip(out, (np.full(len(rows), q), rows, scores.astype(np.int64)), strict=True):
            store.append(x)
    return out


def scored(visits: DataFrame, block: list[tuple[int, list[str]]], weight: dict[str, int], floor: np.ndarray, index: tuple[int, int], k: int) -> DataFrame:
    """_at (place in the block), doc_id, score: the best of every batch of visited rows (with ``queries``, the places that visit)."""
    words = sorted(weight)
    place = {t: i for i, t in enumerate(words)}
    lists = [np.array([place[t] for t in terms if t in place], dtype=np.int64) for _, terms in block]
    weights = np.array([weight[t] for t in words], dtype=np.int64)
    kind = visits.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(words, pa.string())
        for batch in batches:
            q, rows, score = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in best_of(batch, vocabulary, weights, lists, floor, index, k))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), batch.column("doc_id").take(pa.array(rows)), pa.array(score, pa.int64())], ["_at", "doc_id", "score"])

    return visits.select("doc_id", "n", "terms", "tfs", "queries").mapInArrow(run, f"_at int, doc_id {kind}, score long")


def weight_of(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def frequencies(index: Index, words: list[str]) -> dict[str, int]:
    """In how many documents each of the given terms is; the words of a block are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = pa.array(words, pa.string()), np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            place = pc.fill_null(pc.index_in(listed(batch.column("terms"))[0], value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            hit = place >= 0
            np.add.at(total, place[hit], unpacked(batch.column("dfs"))[hit])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "df"])

    found = index.bounds.select("terms", "dfs").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df"))
    return {words[r["at"]]: r["df"] for r in found.collect()}


def bounds_of(index: Index, block: list[tuple[int, list[str]]], weight: dict[str, int]) -> DataFrame:
    """_at, shard, bound: what a document of a shard scores at most for a query of the block, where that is not 0."""
    words = sorted(weight)
    place = {t: i for i, t in enumerate(words)}
    pairs = np.array([(place[t], i) for i, (_, terms) in enumerate(block) for t in terms if t in place], dtype=np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    weights = np.array([weight[t] for t in words], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, first = pa.array(words, pa.string()), np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                terms, sizes = listed(some.column("terms"))
                term = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(term >= 0)
                owner, term = np.repeat(np.arange(some.num_rows), sizes)[hit], term[hit]
                worth = weights[term] * unpacked(some.column("shares"))[hit]
                # Each term of a shard meets the queries that have it.
                n = first[term + 1] - first[term]
                query = pairs[np.repeat(first[term] - np.cumsum(n) + n, n) + np.arange(n.sum()), 1]
                total = np.bincount(np.repeat(owner, n) * len(block) + query, weights=np.repeat(worth, n), minlength=some.num_rows * len(block))
                cell = np.flatnonzero(total)
                shards = some.column("shard").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(cell % len(block), pa.int32()), pa.array(shards[cell // len(block)]), pa.array(total[cell].astype(np.int64))], ["_at", "shard", "bound"])

    found = index.bounds.select("shard", "terms", "shares").mapInArrow(run, "_at int, shard long, bound long")
    return found.groupBy("_at", "shard").agg(F.sum("bound").alias("bound"))


def first_k(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each query with their ranks: by score, then doc_id, none last."""
    order = Window.partitionBy("_at").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(index: Index, block: list[tuple[int, list[str]]], k: int) -> DataFrame:
    """_at, rank, doc_id, score for the queries of a block, stored."""
    spark = index.rows.sparkSession
    scratch = Scratch(spark, "visits")
    weight = {t: weight_of(n, index.n_docs) for t, n in frequencies(index, sorted({t for _, terms in block for t in terms})).items()}
    bound = bounds_of(index, block, weight)
    by = Window.partitionBy("_at")
    place = F.row_number().over(by.orderBy(F.desc("bound"), "shard")) - 1
    bound = scratch.keep(bound.select("_at", "shard", "bound", (place / F.count("*").over(by)).alias("part")))
    floor, best, last = np.zeros(len(block), dtype=np.int64), None, 0.0
    for to in ROUNDS:
        least = spark.createDataFrame([(i, int(x)) for i, x in enumerate(floor)], "_at int, floor long")
        visit = bound.where((F.col("part") >= last) & (F.col("part") < to)).join(F.broadcast(least), "_at").where("bound >= floor")
        visit = scratch.keep(visit.groupBy("shard").agg(F.collect_list("_at").alias("queries")))
        found = scored(index.rows.join(no_bigger(spark, visit, BROADCAST_ROWS), "shard"), block, weight, floor, (index.n_docs, index.n_terms), k)
        best = scratch.keep(first_k(found if best is None else found.unionByName(best.drop("rank")), k))
        # At most one number for each query of the block.
        for r in best.where(F.col("rank") == k).select("_at", "score").collect():
            floor[r["_at"]] = r["score"]
        last = to
    return best


def ranked(docs: DataFrame, queries: DataFrame, *, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (doc_id, text) for each query (item_id, text)."""
    index, asked = build_index(docs), query_terms(queries)
    out = None
    for block in blocks_of(asked):
        places = docs.sparkSession.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], "_at int, _q long")
        found = search_block(index, block, k).join(F.broadcast(places), "_at").select("_q", "rank", "doc_id", "score")
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = index.rows.limit(0).select(F.lit(0).cast("long").alias("_q"), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return out.join(asked.select("_q", "item_id"), "_q").select("item_id", "rank", "doc_id", "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
