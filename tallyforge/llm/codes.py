"""Vector codes: product quantization in whole numbers, the same on every machine and split.

Components become integers ``floor(4096 * x)``, and vectors are cut into ``PARTS`` equal parts.
Every part has a codebook of ``ENTRIES`` entries, which starts as that part of the least
vec_ids; each round assigns all parts to their nearest entries and moves the entries to the
floors of their means. A round is one pass over all vectors: a task adds up its parts by entry,
and Spark sums what the tasks found, ``ENTRIES`` rows a component in all.

Nearest entries are screened by float32 matrix products. A product differs from the true one by
at most ``g * |x| * |c|``, g the usual bound of a sum of rounded products in any order; entries
whose interval of the squared distance overlaps that of the best are evaluated again in int64,
and equal distances go to the lower index. So codes are exact although almost all work is float32.

Defined cases: vectors that are null, empty or hold null or non-finite components are left out, and
so are those with a component so large that squared distances might not fit into 64 bits (46,340 at
64 components), and those of another length than the commonest (of equally common ones the shortest). A length that the
parts do not divide raises. Vectors without a vec_id are coded but start no codebook; with fewer than
``ENTRIES`` vectors the codebooks are shorter. Rows that repeat are separate vectors; an empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows of one matrix product.
TILE = 4096
#: Labels with at least this share of the rows are joined by broadcast: no more than its inverse.
HOT_SHARE = 1 / 1000


def usable_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of vectors: all components, first component of each row, length of each row (0 if not usable)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(length)])
    # Two components differ by twice the largest at most, and length such squares stay under 2 ** 63.
    most = np.sqrt(2.0**63 / np.maximum(length, 1)) / (2 * SCALE) - 1
    with np.errstate(invalid="ignore"):
        bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < np.repeat(most, length)))])
    return flat, start[:-1], np.where(bad[start[1:]] == bad[start[:-1]], length, 0)


def whole(flat: np.ndarray, start: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The chosen rows in whole numbers."""
    return np.floor(SCALE * flat[start[rows][:, None] + np.arange(width)]).astype(np.int64)


def exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    d = x - entries
    return (d * d).sum(axis=1)


def screened(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries can be nearest to each row: true for every one whose interval overlaps the best."""
    m = x.shape[1]
    g = (m + 2) * 2.0**-24
    g /= 1 - g
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    x, book = x.astype(np.float64), book.astype(np.float64)
    squares = (book * book).sum(axis=1)
    # Distances less the row's own square, which all entries share. The margins cover the float64 steps as well.
    near = squares - 2 * product
    slack = (2 * g * np.sqrt((x * x).sum(axis=1)))[:, None] * np.sqrt(squares) * (1 + 1e-9)
    slack += 1e-13 * (squares + 2 * np.abs(product))
    return near - slack <= (near + slack).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The index of each row's nearest entry by squared distance, ties to the lower index."""
    out = np.empty(len(x), dtype=np.int64)
    for at in range(0, len(x), TILE):
        some = x[at : at + TILE]
        may = screened(some, book)
        best = may.argmax(axis=1)
        open_rows = np.flatnonzero(may.sum(axis=1) > 1)
        row, entry = np.nonzero(may[open_rows])
        distance = np.full((len(open_rows), len(book)), np.iinfo(np.int64).max)
        distance[row, entry] = exact(some[open_rows[row]], book[entry])
        best[open_rows] = distance.argmin(axis=1)
        out[at : at + TILE] = best
    return out


def first_vectors(vectors: DataFrame, entries: int) -> tuple[int, np.ndarray]:
    """The commonest length, and the vectors of the least vec_ids that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, start, length = usable_rows(batch.column("embedding"))
            rank = pc.rank(batch.column("vec_id"), null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False)
            named = pc.is_valid(batch.column("vec_id")).to_numpy(zero_copy_only=False)
            lengths, counts, ids, found = [], [], [], []
            for width in np.unique(length[length > 0]):
                rows = np.flatnonzero(length == width)
                lengths.append(width), counts.append(len(rows)), ids.append(None), found.append(None)
                rows = rows[named[rows]]
                if len(rows) > entries:
                    rows = rows[rank[rows] <= np.partition(rank[rows], entries - 1)[entries - 1]]
                x = whole(flat, start, rows, width)
                if len(rows) > entries:
                    order = np.lexsort([*x.T[::-1], rank[rows]])[:entries]
                    rows, x = rows[order], x[order]
                lengths += [width] * len(rows)
                counts += [0] * len(rows)
                ids += rows.tolist()
                found += list(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lengths, pa.int64()), pa.array(counts, pa.int64()), batch.column("vec_id").take(pa.array(ids, pa.int64())), pa.array(found, pa.list_(pa.int64()))], ["length", "n", "vec_id", "vector"]
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    scratch = Scratch(vectors.sparkSession, "codes")
    seeds = scratch.keep(vectors.select("vec_id", "embedding").mapInArrow(run, f"length long, n long, vec_id {kind}, vector array<long>"))
    width = seeds.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "length").first()
    if width is None:
        return 0, np.empty((0, 0), dtype=np.int64)
    width = width["length"]
    least = seeds.where((F.col("length") == width) & F.col("vector").isNotNull()).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries)
    out = np.array([r["vector"] for r in least.collect()], dtype=np.int64).reshape(-1, width)
    scratch.drop(seeds)
    return width, out


def moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after one round over all vectors."""
    parts, entries, m = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A component more counts the rows.
        total = np.zeros((parts, entries, m + 1), dtype=np.int64)
        for batch in batches:
            flat, start, length = usable_rows(batch.column("embedding"))
            x = whole(flat, start, np.flatnonzero(length == parts * m), parts * m)
            for p in range(parts):
                part = x[:, p * m : (p + 1) * m]
                code = nearest(part, books[p])
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                if len(used):
                    total[p, used, :m] += np.add.reduceat(part[order], first, axis=0)
                    total[p, used, m] += np.diff(np.r_[first, len(order)])
        p, e, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(e, pa.int64()), pa.array(c, pa.int64()), pa.array(total[p, e, c])], ["part", "entry", "at", "total"])

    sums = vectors.select("embedding").mapInArrow(run, "part long, entry long, at long, total long")
    total = np.zeros((parts, entries, m + 1), dtype=np.int64)
    # At most one row for each component of the codebooks.
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect():
        total[r["part"], r["entry"], r["at"]] = r["total"]
    n = total[:, :, m:]
    return np.where(n > 0, total[:, :, :m] // np.maximum(n, 1), books)


def fitted(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) for vectors (vec_id, embedding)."""
    width, first = first_vectors(vectors, entries)
    if width % parts:
        raise ValueError(f"vectors of length {width} cannot be cut into {parts} equal parts")
    books = first.reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        books = moved(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error for every usable vector of (vec_id, label, embedding)."""
    parts, _, m = books.shape
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, start, length = usable_rows(batch.column("embedding"))
            rows = np.flatnonzero((length > 0) & (length == parts * m) & (books.size > 0))
            x = whole(flat, start, rows, parts * m)
            codes, error = np.empty((len(rows), parts), dtype=np.uint8), np.zeros(len(rows), dtype=np.int64)
            for p in range(parts):
                part = x[:, p * m : (p + 1) * m]
                code = nearest(part, books[p])
                codes[:, p] = code
                error += exact(part, books[p][code])
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the errors summed over equal labels, nulls together; ``coded`` is a stored table.

    Labels of a thousandth of the rows or more are a thousand at most and are broadcast; no other label is hot.
    """
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    rows = coded.count()
    same = F.col("label").eqNullSafe(F.col("_label"))
    hot = F.broadcast(totals.where(F.col("_n") >= rows * HOT_SHARE))
    first = coded.join(hot, same, "left")
    rest = first.where("_n is null").drop("_label", "label_error", "_n").join(totals.where(F.col("_n") < rows * HOT_SHARE), same)
    return first.where("_n is not null").unionByName(rest).drop("_label", "_n")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes with errors (vec_id, label, code, error, label_error), and the codebooks that decode them."""
    books = fitted(vectors, parts=parts, entries=entries, rounds=rounds)
    coded = Scratch(vectors.sparkSession, "coded").keep(encode(vectors, books))
    return with_label_errors(coded), books


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The whole-number vector that a code stands for."""
    return np.concatenate([books[p][e] for p, e in enumerate(bytes.fromhex(code))])


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compressed(read(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
