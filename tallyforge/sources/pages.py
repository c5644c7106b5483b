"""Card metadata from stored pages of an API that link to their next page.

Pages are rows of set (its place among the sets that are united), url, next_page and data. Nothing
is told by file names or the order of rows: places follow from the links by pointer jumping, a
join a round, in log2 of the longest chain's rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .drafts import _card_array
from .manifest import CheckFailed
from .store import stored


def read_pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Saved pages (JSON objects with ``url``, ``next_page`` and ``data``) of several sets, one path a set, later sets winning."""
    every = None
    for i, path in enumerate(paths):
        one = spark.read.schema(f"url string, next_page string, data {_card_array()}").json(path, multiLine=True).select(F.lit(i).alias("set"), "*")
        every = one if every is None else every.unionByName(one)
    return every


def placed(pages: DataFrame) -> DataFrame:
    """Adds ``place``, a page's number from 0 along its chain; chains that start apart and meet are refused.

    A url stored twice, a link to a page that is not there, two links to one page and links in a circle raise ``CheckFailed``:
    the table would not be whole, or its order not defined. A null link ends a chain.
    """
    links = stored(pages.select("set", "url", "next_page"), "links")
    once = links.groupBy("set", "url").agg(F.count("*").alias("n"))
    told = links.where("next_page is not null").groupBy("set", F.col("next_page").alias("url")).agg(F.count("*").alias("m"))
    seen = once.join(told, ["set", "url"], "full").agg(F.count_if(F.expr("n > 1")).alias("repeated"), F.count_if(F.expr("n is null")).alias("missing"), F.count_if(F.expr("m > 1")).alias("met"), F.count("n").alias("pages"), F.count_if(F.expr("url is null")).alias("nameless")).first()
    if bad := {k: seen[k] for k in ("repeated", "missing", "met", "nameless") if seen[k]}:
        raise CheckFailed(f"pages do not make chains: {bad}")
    # back: the page ``done`` links before a page, null once that is past the start.
    back = links.join(links.select("set", F.col("url").alias("back"), F.col("next_page").alias("url")).where("url is not null"), ["set", "url"], "left").select("set", "url", "back", F.col("back").isNotNull().cast("long").alias("place"))
    span = 1
    while True:
        back = stored(back, "back")
        if back.where("back is not null").limit(1).count() == 0:
            break
        if span > max(seen["pages"], 1):
            raise CheckFailed("pages link in a circle")
        hop = back.select("set", F.col("url").alias("back"), F.col("back").alias("further"), F.col("place").alias("more"))
        back = back.join(hop, ["set", "back"], "left").select("set", "url", F.col("further").alias("back"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))
        span *= 2
    return pages.join(back.select("set", "url", "place"), ["set", "url"])


def cards(pages: DataFrame) -> DataFrame:
    """One row a card name of all sets: its last entry by set, place of the page (of its chain, then url) and place in the page."""
    entries = placed(pages).select("set", "place", "url", F.posexplode("data").alias("at", "c"))
    return entries.groupBy("c.name").agg(F.max_by("c", F.struct("set", "place", "url", "at")).alias("c")).select("c.*")
