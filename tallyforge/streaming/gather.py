"""Whole drafts from a stream of single picks, and their state.

Picks come in any order, a row each with the time it was made. A draft is a session of its picks: it
is let go when the watermark, the latest time seen less ``lateness``, has passed its last pick by ``gap``.
Picks older than the watermark that the batch before began with are dropped and counted in the query's progress
(``numRowsDroppedByWatermark``), as a draft that was let go cannot change. A draft with a break longer than
``gap`` is two drafts, so the start of the session is part of its id. Rows without a draft or time
belong to no draft. A pick told twice with the same place, card and time counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state
from ..sources.tables import Facts, pack_offers


def drafts(picks: DataFrame, *, at: str = "at", gap: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """draft_id, pack, pick_no, card of drafts that are complete by the watermark; ``picks`` has these and ``at``."""
    known = picks.where(F.col("draft_id").isNotNull() & F.col(at).isNotNull()).withWatermark(at, lateness)
    entry = F.struct("pack", "pick_no", "card", F.col(at).alias("at"))
    whole = known.groupBy("draft_id", F.session_window(at, gap).alias("w")).agg(F.collect_set(entry).alias("entries"))
    name = F.concat_ws("/", F.col("draft_id").cast("string"), F.unix_millis("w.start").cast("string")).alias("draft_id")
    return whole.select(name, F.explode("entries").alias("e")).select("draft_id", "e.pack", "e.pick_no", "e.card")


def keep_state(picks: DataFrame, cards: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Put the state of every micro-batch of whole drafts under ``path``; a batch that is run again replaces its own."""

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            state.put(Facts(batch, pack_offers(batch), cards), path, f"batch {number}")
        finally:
            batch.unpersist()

    return picks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
