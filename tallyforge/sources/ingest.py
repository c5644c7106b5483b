"""A wide log to narrow stored facts in one scan.

The scan keeps the draft's id, the pick and one array of shown cards a row, and marks each row
with the first row of its stretch: rows of one draft that stand together in a block of the file.
Stretches over the edge of a block are stitched on a table of one row a block, so the log is
neither shuffled nor sorted. A row whose id is null belongs to the stretch of null ids around it.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .drafts import PACK_PREFIX, card_columns
from .store import stored
from .tables import Facts

ORDER = ("_file", "_block")


def narrow(log: DataFrame, names: list[str]) -> DataFrame:
    """draft_id, pack, pick_no, card, shown (of cards with copies) and where the row of a located log stands."""
    cells = F.array(*[F.struct(F.lit(c).alias("card"), F.expr(f"try_cast(`{PACK_PREFIX}{c}` AS double)").alias("n")) for c in names])
    shown = F.filter(cells, lambda x: F.coalesce(x["n"], F.lit(0.0)) > 0)
    return log.select("draft_id", F.col("pack_number").cast("int").alias("pack"), F.col("pick_number").cast("int").alias("pick_no"), F.col("pick").alias("card"), shown.alias("shown"), *ORDER, "_row")


def stretches(rows: DataFrame) -> DataFrame:
    """Adds ``_stretch``, the ``_row`` of the first row of a row's stretch. Rows that are not in order only make more stretches."""
    names = ["draft_id", *ORDER]

    def run(batches):
        last, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            same = pa.array([True] * (batch.num_rows - 1))
            for name in names:
                column = batch.column(name)
                filled = pc.fill_null(pc.equal(column[1:], column[:-1]), False)
                same = pc.and_(same, pc.or_(filled, pc.and_(pc.is_null(column[1:]), pc.is_null(column[:-1]))))
            at = batch.column("_row")
            same = pc.and_(same, pc.equal(pc.subtract(at[1:], at[:-1]), 1))
            head = tuple(batch.column(n)[0].as_py() for n in names)
            goes_on = last is not None and last == (*head, at[0].as_py() - 1)
            starts = pc.if_else(same, pa.scalar(None, pa.int64()), at[1:])
            opening = pa.array([first if goes_on else at[0].as_py()], pa.int64())
            marked = pc.fill_null_forward(pa.concat_arrays([opening, starts]))
            first = marked[-1].as_py()
            last = (*(batch.column(n)[-1].as_py() for n in names), at[-1].as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns, marked], names=[*batch.schema.names, "_stretch"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_stretch", T.LongType())]))


def heads(marked: DataFrame) -> DataFrame:
    """``_stretch``, ``_head`` (the first stretch of its run) and ``position`` (the run's number from 0 in file order).

    Windows run within a block, and over a table of one row a block (128 MB of log by default).
    """
    every = marked.select("_stretch", "draft_id", *ORDER).distinct()
    within = Window.partitionBy(*ORDER).orderBy("_stretch")
    every = every.withColumn("_joined", (F.row_number().over(within) > 1) & F.col("draft_id").eqNullSafe(F.lag("draft_id").over(within)))
    every = every.withColumn("_first", F.max(F.when(~F.col("_joined"), F.col("_stretch"))).over(within))
    every = every.withColumn("_at", F.sum((~F.col("_joined")).cast("int")).over(within))
    edges = every.groupBy(*ORDER).agg(
        F.min_by("draft_id", "_stretch").alias("opens"), F.max_by("draft_id", "_stretch").alias("closes"), F.min("_first").alias("low"), F.max("_first").alias("high"), F.max("_at").alias("n")
    )
    # max_by and min_by pass a null id on as null, and so does lag; the first block follows nothing.
    line = Window.orderBy(*ORDER)
    edges = edges.withColumn("goes_on", (F.row_number().over(line) > 1) & F.col("opens").eqNullSafe(F.lag("closes").over(line)))
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(~(F.col("goes_on") & (F.col("n") == 1)), F.col("high"))
    edges = edges.withColumn("_came", F.last(own, ignorenulls=True).over(before))
    edges = edges.withColumn("_offset", F.coalesce(F.sum(F.col("n") - F.col("goes_on").cast("int")).over(before), F.lit(0)) - F.col("goes_on").cast("int"))
    out = every.join(edges.select(*ORDER, "low", "goes_on", "_came", "_offset"), [*ORDER])
    head = F.when(F.col("goes_on") & (F.col("_first") == F.col("low")), F.col("_came")).otherwise(F.col("_first"))
    return out.select("_stretch", head.alias("_head"), (F.col("_offset") + F.col("_at") - 1).alias("position"))


def log_tables(log: DataFrame, expected: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """picks, offers and ``drafts`` (draft_id, position) of a located log, from one scan of it.

    ``draft_id`` becomes the log's id and the run's number, since ids come back in other runs.
    """
    rows = stored(stretches(narrow(log, card_columns(log, expected))), "log")
    known = stored(heads(rows), "heads")
    run = F.concat_ws("/", "draft_id", F.col("position").cast("string")).alias("draft_id")
    rows = rows.join(known.select("_stretch", "position"), "_stretch").select(run, "pack", "pick_no", "card", "shown", "position")
    shown = rows.select("draft_id", "pack", "pick_no", F.explode("shown").alias("x")).select("draft_id", "pack", "pick_no", "x.card", "x.n")
    offers = shown.groupBy("draft_id", "pack", "card").agg(F.coalesce(F.max(F.when(F.col("pick_no") == 0, F.col("n"))), F.lit(0.0)).cast("long").alias("n_first"), F.count("*").alias("n_rows"))
    return rows.select("draft_id", "pack", "pick_no", "card"), offers, rows.select("draft_id", "position").distinct()


def half_of(facts: Facts, wanted: DataFrame) -> Facts:
    """Facts of the drafts whose ids ``wanted`` holds."""
    return Facts(facts.picks.join(wanted, "draft_id", "left_semi"), facts.offers.join(wanted, "draft_id", "left_semi"), facts.cards)
