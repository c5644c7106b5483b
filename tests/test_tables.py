"""Picks and offers of the order tables come from one shuffle by customer."""

from pyspark.sql import functions as F

from tallyforge.sources import tables

SMALL = "/root/testdata/sf0.001"


def test_picks_and_offers_take_one_shuffle_of_thin_rows(spark):
    picks = tables.order_picks(spark, SMALL)
    both = tables.shown(picks)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == picks._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert not any(c in plan for c in ("l_suppkey", "l_shipdate", "l_extendedprice"))
    offers = both.where("once").select("draft_id", "pack", "card", "n_first", "n_rows")
    assert offers.exceptAll(tables.pack_offers(picks)).isEmpty() and tables.pack_offers(picks).exceptAll(offers).isEmpty()


def test_picks_are_those_of_an_order_by_all_columns(spark):
    read = {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("lineitem", "orders", "part")}
    for t, df in read.items():
        df.createOrReplaceTempView(f"picks_{t}")
    plain = spark.sql("""SELECT o_custkey, cast((n - 1) div 10 as int), cast((n - 1) % 10 as int), p_brand FROM (
      SELECT o_custkey, p_brand, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS n
      FROM picks_lineitem JOIN picks_orders ON l_orderkey = o_orderkey JOIN picks_part ON l_partkey = p_partkey) WHERE n <= 30""")
    found = tables.order_picks(spark, SMALL)
    assert found.count() == plain.count() and found.exceptAll(plain).isEmpty() and found.agg(F.count("card")).first()[0] > 100
