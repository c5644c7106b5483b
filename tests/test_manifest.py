"""Stored tables: what is half written, cut, of another format or breaks a check is never read."""

import os

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import manifest


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    manifest.save(spark.range(50).repartition(3), path, "ids", 2, source={"log": [1, 2]}, facts={"even": F.count_if(F.col("id") % 2 == 0)})
    return path


def test_round_trip(spark, table):
    assert manifest.load(spark, table, "ids", 2).count() == 50
    what = manifest.manifest(spark, table)
    assert what["rows"] == 50 and what["observed"] == {"even": 25}
    assert manifest.fresh(spark, table, "ids", 2, {"log": [1, 2]}) and not manifest.fresh(spark, table, "ids", 2, {"log": [1, 3]})
    again = manifest.save(spark.range(7), table, "ids", 2)
    assert again.count() == 7 and manifest.load(spark, table, "ids", 2).count() == 7


def test_other_tables_are_refused(spark, table):
    for kind, version, schema in (("names", 2, None), ("ids", 3, None), ("ids", 2, spark.range(1).select(F.col("id").cast("int")).schema), ("ids", 2, spark.range(1).withColumnRenamed("id", "x").schema)):
        with pytest.raises(manifest.CheckFailed):
            manifest.load(spark, table, kind, version, schema=schema)
    with pytest.raises(manifest.CheckFailed):
        manifest.load(spark, table + "x", "ids", 2)


def test_lost_and_cut_files(spark, table):
    folder = os.path.join(table, manifest.manifest(spark, table)["data"])
    part = next(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet"))
    with open(part, "ab") as f:
        f.write(b"x")
    with pytest.raises(manifest.CheckFailed):
        manifest.load(spark, table, "ids", 2)
    os.remove(part)
    with pytest.raises(manifest.CheckFailed):
        manifest.load(spark, table, "ids", 2)


def test_broken_checks_publish_nothing(spark, table):
    with pytest.raises(manifest.CheckFailed, match="big"):
        manifest.save(spark.range(9), table, "ids", 2, checks={"big": F.col("id") > 7, "none": F.col("id") < 0})
    assert manifest.load(spark, table, "ids", 2).count() == 50
    assert len([f for f in os.listdir(table) if f.startswith("data-")]) == 1
    with pytest.raises(manifest.CheckFailed):
        manifest.publish(spark.range(9), table + "p", {"big": F.col("id") > 7})
    assert not os.path.exists(table + "p")


def test_publish_replaces_and_empties(spark, tmp_path):
    path = str(tmp_path / "p")
    assert manifest.publish(spark.range(9).withColumn("n", F.lit(1)), path, {"low": F.col("n") < 1}, drop=["n"])["rows"] == 9
    assert manifest.publish(spark.range(0), path, {"low": F.col("id") < 1})["rows"] == 0
    assert spark.read.parquet(path).columns == ["id"] and spark.read.parquet(path).count() == 0
