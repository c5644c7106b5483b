"""Picks that stream in out of order end in the statistics of one pass."""

from pyspark.sql import functions as F

from tallyforge.operators import iv, state
from tallyforge.sources.tables import order_facts
from tallyforge.streaming import gather


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))) for r in df.collect())


def test_any_order_gives_one_pass(spark, tmp_path):
    x = order_facts(spark, "/root/testdata/sf0.001")
    # Drafts start a minute apart and take an hour; files hold a third of all picks each, dealt by hash.
    minute = F.col("draft_id") + (F.col("pack") * 10 + F.col("pick_no")) * 2
    timed = x.picks.withColumn("at", F.timestamp_seconds(1_700_000_000 + minute * 60))
    cut = F.pmod(F.xxhash64("draft_id", "pack", "pick_no"), F.lit(3))
    for i in range(3):
        timed.where(cut == i).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    # Told twice, without a draft or a time: no change. A pick of far later lets all drafts go; its own stays open.
    odd = timed.where(cut == 2).unionByName(timed.limit(5).withColumn("at", F.lit(None).cast("timestamp"))).unionByName(timed.limit(5).withColumn("draft_id", F.lit(None).cast("long")))
    odd.coalesce(1).write.parquet(f"{tmp_path}/in/part3")
    # The batch after it lets them go, and is the first whose watermark later rows are held against.
    for i in (4, 5):
        timed.limit(1).withColumn("at", F.col("at") + F.expr("interval 90 days")).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    # A pick of an old draft after that is late and changes nothing.
    timed.limit(1).withColumn("card", F.lit("other")).coalesce(1).write.parquet(f"{tmp_path}/in/part6")
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    whole = gather.drafts(stream, lateness="30 days")
    query = gather.keep_state(whole, x.cards, f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    assert rows(state.effects(state.merge(spark, f"{tmp_path}/out"))) == rows(iv.reference_effects(x))
