"""Shared helpers: durable intermediate tables, Arrow maps, text bytes."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder

#: Bytes of text that one numpy block holds at most (a single longer text is its own block).
BLOCK_BYTES = 4 << 20


#: Removes the shuffle files of a query when it ends; nothing reads them again after a table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one operator run, written under the shared folder.

    A written table cuts the lineage and survives lost executors. ``drop`` removes
    tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        schema = df.schema
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        kept = self.spark.read.schema(schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def no_bigger(spark: SparkSession, df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``f`` to every Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null becomes empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def blocks(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[slice]:
    """Consecutive slices of rows whose sizes sum to ``limit`` at most, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def unit(h: Column) -> Column:
    """A signed 64-bit hash as a double strictly between 0 and 1."""
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 text; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt over all cores if their files come in fewer splits than there are cores.

    Texts are long to process for their bytes; a large table has splits enough and stays as read.
    """
    docs = read(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


class Taken:
    """The stretches that some (start, end) spans take, to ask of others whether they overlap any."""

    def __init__(self, spans: Iterator[tuple[int, int]] | list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, a: int, b: int) -> bool:
        """Whether a span shares a place with any; spans are not empty."""
        i = bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a
