"""A generated draft log through every command."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge import cli, workflow
from tallyforge.operators import facts
from tallyforge.sources import drafts

CARDS = [f"Card {i}, the '{'Red' if i % 2 else 'Blue'}'" for i in range(8)]


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    """Three packs of four picks from packs of four; ids come back, and some drafts break off."""
    root = tmp_path_factory.mktemp("set")
    (root / "data/drafts").mkdir(parents=True)
    (root / "data/metadata").mkdir()
    rng, lines = random.Random(1), [",".join(["draft_id", "pack_number", "pick_number", "pick", *(f'"pack_card_{c}"' for c in CARDS), "pool_x"])]
    for d in range(400):
        for pack in range(3):
            shown = rng.sample(range(8), 4)
            for pick in range(4 if d % 11 or pack < 2 else 2):
                taken = rng.choice(shown)
                cells = ["1" if i in shown else rng.choice(["", "0"]) for i in range(8)]
                lines.append(",".join([f"d{d % 390}", str(pack), str(pick), f'"{CARDS[taken]}"', *cells, "7"]))
                shown.remove(taken)
    (root / "data/drafts/log of AAA.csv").write_text("\n".join(lines) + "\n")
    meta = {c: {"name": c, "colors": ["R" if i % 2 else "U"], "mana_cost": "{1}{R}" if i % 2 else "{U}", "cmc": 2.0 if i % 2 else 1.0, "type_line": "Creature", "rarity": "rare" if i < 3 else "common"} for i, c in enumerate(CARDS)}
    (root / "data/metadata/metadata.AAA.json").write_text(json.dumps(meta))
    (root / "data/metadata/groups.AAA.json").write_text(json.dumps({c: "R_Creature" if i % 2 else "U_Creature" for i, c in enumerate(CARDS)}))
    path = root / "config.json"
    path.write_text(json.dumps({"paths": {"data_dir": str(root / "data"), "results_dir": str(root / "results"), "registry": {"AAA": "log of AAA.csv.gz"}}}))
    (root / "methods").write_text("satt\n# none\nsatt_offered\ndm_impute_t_att_lin\nsipw_logit\n")
    return path


def test_commands(spark, config):
    root = config.parent
    run = lambda *a: cli.main([*a, "--config", str(config)])
    table = lambda name: spark.read.parquet(str(root / "results" / name))
    run("build-reference-effects", "AAA", "--least-picked", "20", "--most-ratio", "9")
    effects = table("ref.AAA")
    assert effects.count() == 16 and effects.columns[0] == "set_code"
    run("build-baseline-estimates", "AAA", str(root / "methods"))
    assert table("estimates.AAA").groupBy("method").count().where("count = 16").count() == 4
    value = lambda: {(r["card_a"], r["group_b"]): r["value"] for r in table("estimates.AAA").where("method = 'sipw_logit'").collect()}
    before = value()
    (root / "profiles.json").write_text(json.dumps({"logit": {"c": 1e-9}}))
    run("build-baseline-estimates", "AAA", str(root / "methods"), "--idx", "1", "--filter", "Red", "--profiles", str(root / "profiles.json"))
    assert 0 < sum(abs(v - before[k]) > 1e-9 for k, v in value().items()) <= 2, "one card has other settings"
    assert table("estimates.AAA").count() == 64, "one card is replaced, not added"
    run("independence-diagnostic", "AAA")
    run("instrument-diagnostic", "AAA")
    run("slot-diagnostic", "AAA", "--least-picked", "20")
    assert table("independence.AAA").count() == 16 and table("exclusion_diagnostic.AAA").count() == 16
    run("hp-tuning-sample", "AAA", "logit", "--seed", "3")
    assert table("tuning.logit.3.AAA").where("best").count() == 1
    run("create-summary", "topic", "AAA", str(root / "methods"))
    summary = table("topic")
    assert summary.count() == 16 and {"satt", "satt_offered", "dm_impute_t_att_lin", "sipw_logit"} <= set(summary.columns)
    assert summary.where("satt is null").count() == 0
    # Split halves: effects from one, estimates from the other.
    run("build-reference-effects", "AAA", "--split", "5", "--least-picked", "20", "--most-ratio", "9")
    run("build-baseline-estimates", "AAA", str(root / "methods"), "--split", "5")
    run("create-summary", "halves", "AAA", str(root / "methods"), "--split", "5")
    assert table("halves").count() > 0
    cli.main(["list-estimators"])
    with pytest.raises(SystemExit):
        cli.main(["no-such-command"])


def test_file_order(spark, config):
    space = workflow.Workspace.load(spark, str(config))
    log = drafts.placed(drafts.read_log(spark, space.log(spark, "AAA"), located=True))
    with open(config.parent / "data/drafts/log of AAA.csv") as f:
        ids = [line.split(",")[0] for line in f][1:]
    assert [r[0] for r in log.orderBy("row_pos").select("draft_id").collect()] == ids
    assert [r[0] for r in log.orderBy("row_pos").select("row_pos").collect()] == list(range(len(ids)))
    halves = [workflow.set_facts(spark, space, "AAA", split=5, upper=u) for u in (False, True)]
    a, b = ({r[0] for r in x.picks.select("draft_id").distinct().collect()} for x in halves)
    draws = random.Random(5)
    lower = [draws.random() < 0.5 for _ in range(400)]
    assert len(a) == sum(lower) and len(b) == 400 - sum(lower) and not a & b
    assert facts.lengths(workflow.set_facts(spark, space, "AAA").picks).count() == 400
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        again = drafts.placed(drafts.read_log(spark, space.log(spark, "AAA"), located=True))
        assert [r[0] for r in again.orderBy("row_pos").select("draft_id").collect()] == ids
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)


def test_two_roots(spark, tmp_path):
    for root in "ab":
        (tmp_path / root / "drafts").mkdir(parents=True)
    space = workflow.Workspace(str(tmp_path / "b"), "x", str(tmp_path / "a"))
    with pytest.raises(FileNotFoundError):
        space.log(spark, "S")
    (tmp_path / "b/drafts/S.csv.gz").write_text("")
    assert space.log(spark, "S") == f"{tmp_path}/b/drafts/S.csv.gz"
    (tmp_path / "a/drafts/S.csv.gz").write_text("")
    with pytest.raises(ValueError):
        space.log(spark, "S")
    space.fail_duplicate = False
    assert space.log(spark, "S") == f"{tmp_path}/a/drafts/S.csv.gz"


def test_numbers_in_order(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 1009).alias("k")).repartition(5)
    out = drafts.numbered(rows, "k", "n").orderBy("k").collect()
    assert [r["n"] for r in out] == list(range(500))
