"""Runs of a log, in one scan and in any cut of it, and draws by jumps, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import twister
from tallyforge.operators import facts
from tallyforge.sources import ingest
from tallyforge.sources.store import stored


@pytest.mark.parametrize("start", [0, 1, 311, 312, 9_968, 123_457, 2_000_003])
def test_draws_at_any_place(start):
    rng = random.Random(start + 5)
    for _ in range(start):
        rng.random()
    assert twister.draws(start + 5, start, 700).tolist() == [rng.random() for _ in range(700)]


def test_jumps_add_up():
    far = twister.ahead(twister.seeded(3), 10**13 + 10**12)
    twice = twister.ahead(twister.ahead(twister.seeded(3), 10**13), 10**12)
    assert twister.words_after(far, 50)[624:].tolist() == twister.words_after(twice, 50)[624:].tolist()


def test_split_by_spans(spark):
    rng = random.Random(9)
    expected = [int(rng.random() >= 0.5) for _ in range(500)]
    ids = spark.range(500).select(F.col("id").alias("draft_id"), F.col("id").alias("position")).where("id % 7 <> 3").repartition(5)
    for span in (1, 37, 1 << 20):
        got = {r["draft_id"]: r["half"] for r in facts.split_in_order(ids, 9, span=span).collect()}
        assert got == {i: h for i, h in enumerate(expected) if i % 7 != 3}


def plain_runs(ids):
    out, n = [], -1
    for i, name in enumerate(ids):
        if i == 0 or name != ids[i - 1]:
            n += 1
        out.append(n)
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("sizes", [(1,), (3,), (1, 2, 7), (40,)])
def test_runs_over_blocks(spark, seed, sizes):
    """Runs shorter and longer than blocks, ids that come back, null ids, blocks out of order over tasks."""
    rng = random.Random(seed)
    ids = []
    while len(ids) < 120:
        ids += [rng.choice(["a", "b", "c", None])] * rng.choice([1, 2, 5, 30])
    rows, at, block = [], 0, 0
    while at < len(ids):
        k = rng.choice(sizes)
        rows += [(ids[i], f"f{block // 5:03d}", block % 5 * 100, i) for i in range(at, min(at + k, len(ids)))]
        at, block = at + k, block + 1
    whole = spark.createDataFrame(rows, "draft_id string, _file string, _block long, at long")
    parts = whole.repartition(3, "_file", "_block").sortWithinPartitions("_file", "_block", "at").withColumn("_row", F.monotonically_increasing_id())
    marked = stored(ingest.stretches(parts), "marked")  # row numbers hold within one evaluation
    got = marked.join(ingest.heads(marked), "_stretch").collect()
    assert len(got) == len(ids)
    plain = plain_runs(ids)
    assert all(r["position"] == plain[r["at"]] for r in got)
    assert len({r["_head"] for r in got}) == len(set(plain))


def test_empty_log(spark):
    none = spark.createDataFrame([], "draft_id string, _file string, _block long, _row long")
    marked = ingest.stretches(none)
    assert marked.count() == 0 and ingest.heads(marked).count() == 0
