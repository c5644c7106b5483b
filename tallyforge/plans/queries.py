"""The registered queries over the order tables' draft facts.

Floating results are rounded to six digits, so that engines compare by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cards as C
from ..operators import balance, boosted, cells, exclusion, facts, features, fdr, grams, iv, metrics, models, neighbours, resample, state
from ..operators.estimators import naive, ridge_imputation
from ..sources import drafts, pages
from ..sources.store import shared_folder, stored
from ..sources.tables import Facts, order_facts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Replicates of all bootstraps: what the significance test needs, and no fewer than the 1,000 that intervals and ranks ask.
BOOT = 10_000
SPLIT_SEED = 7


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits (minus zero to zero), integers to bigint."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.round(c, 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def query(f: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(order_facts(spark, sf_dir)))
    return f


def plain(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


@query
def reference_effects(x: Facts) -> DataFrame:
    return iv.reference_effects(x)


@query
def iv_sufficient_stats(x: Facts) -> DataFrame:
    return iv.sufficient_stats(x)


@query
def pick_stats(x: Facts) -> DataFrame:
    return facts.pick_stats(x)


@query
def unknown_picks(x: Facts) -> DataFrame:
    return facts.unknown_picks(x.picks, x.cards.where("no % 6 <> 0"))


@query
def treatment_selector(x: Facts) -> DataFrame:
    return facts.treatment_selector(facts.pick_stats(x), least_picked=10, most_ratio=9.5)


@query
def slot_selector(x: Facts) -> DataFrame:
    return facts.slot_selector(facts.pick_stats(x), x.cards, least_picked=10)


@query
def pack_length_hist(x: Facts) -> DataFrame:
    return facts.pack_length_hist(x.picks)


@query
def draft_completeness(x: Facts) -> DataFrame:
    return facts.drafts(x)


@query
def incomplete_rate(x: Facts) -> DataFrame:
    return facts.incomplete_rate(x.picks)


@query
def prior_holders(x: Facts) -> DataFrame:
    return facts.held_of(x)


@query
def draft_accounting(x: Facts) -> DataFrame:
    return facts.draft_accounting(x)


@query
def outcome_counts(x: Facts) -> DataFrame:
    return facts.counts_of(x, facts.OUTCOME)


@query
def split_halves(x: Facts) -> DataFrame:
    return facts.drafts(x).select("draft_id", facts.split_half(F.col("draft_id"), SPLIT_SEED).alias("half"))


@query
def split_in_order(x: Facts) -> DataFrame:
    """Halves from one sequential draw a draft, drafts in order of their ids."""
    return facts.split_in_order(drafts.numbered(facts.drafts(x).select("draft_id"), "draft_id", "position"), SPLIT_SEED)


@query
def merged_effects(x: Facts) -> DataFrame:
    """Effects and accounting of the state of three sources, put one by one and merged."""
    path = f"{shared_folder(x.picks.sparkSession)}/iv-state-{uuid.uuid4().hex}"
    for i in range(3):
        mine = F.pmod("draft_id", F.lit(3)) == i
        state.put(Facts(x.picks.where(mine), x.offers.where(mine), x.cards), path, f"part {i}")
    return state.effects(state.merge(x.picks.sparkSession, path))


@query
def history_features(x: Facts) -> DataFrame:
    return features.history(x, facts.valid_of(x))


@query
def relative_covariates(x: Facts) -> DataFrame:
    return features.frame(x, features.groups_of(x)).select("draft_id", "card_a", *features.CORE)


@query
def estimation_frame(x: Facts) -> DataFrame:
    groups = features.groups_of(x)
    return features.frame(x, groups).select("draft_id", "card_a", "T", "not_offered", "horizon", *[f"Y_{g}" for g in groups], "n_prior", "n_lands", "n_creatures", "num_colors", "avg_cmc", "oncolor_pip_share")


@query
def balance_smd(x: Facts) -> DataFrame:
    return balance.balance(x)


@query
def diag_quantiles(x: Facts) -> DataFrame:
    return balance.smd_quantiles(balance.balance(x))


@query
def card_quantiles(x: Facts) -> DataFrame:
    return balance.card_quantiles(balance.balance(x))


@query
def exact_match_exclusion(x: Facts) -> DataFrame:
    groups = features.groups_of(x)
    return exclusion.matched_contrast(exclusion.sparse_buckets(x, groups), groups)


@query
def exclusion_summary(x: Facts) -> DataFrame:
    groups = features.groups_of(x)
    return exclusion.drop_summary(exclusion.matched_contrast(exclusion.sparse_buckets(x, groups), groups))


@query
def satt(x: Facts) -> DataFrame:
    return naive(x).drop("method")


@query
def satt_offered(x: Facts) -> DataFrame:
    return naive(x, offered_only=True).drop("method")


@query
def match_cov_k3(x: Facts) -> DataFrame:
    return neighbours.match_covariates(cells.from_facts(x, features.groups_of(x))).drop("method")


@query
def sipw_logit(x: Facts) -> DataFrame:
    return cells.weighted(cells.from_facts(x, features.groups_of(x))).drop("method")


@query
def match_ps_logit_k3(x: Facts) -> DataFrame:
    return neighbours.match_scores(cells.from_facts(x, features.groups_of(x))).drop("method")


@query
def dm_impute_t_att_lin(x: Facts) -> DataFrame:
    groups = features.groups_of(x)
    return ridge_imputation(features.frame(x, groups), groups).drop("method")


def boosted_propensity(x: Facts) -> boosted.Propensity:
    """The boosted propensity over core cells, fitted once for all queries that read it."""
    if "boosted_propensity" not in x.kept:
        x.kept["boosted_propensity"] = boosted.propensity(cells.from_facts(x, features.groups_of(x)), models.PROFILES["gbm_t"])
    return x.kept["boosted_propensity"]


def boosted_outcomes(x: Facts) -> boosted.Outcomes:
    """The boosted control outcomes, fitted once for the queries that read them."""
    if "boosted_outcomes" not in x.kept:
        groups = features.groups_of(x)
        x.kept["boosted_outcomes"] = boosted.outcomes(cells.from_facts(x, groups, tuple(features.covariates(features.frame(x, groups)))), models.PROFILES["gbm_y"])
    return x.kept["boosted_outcomes"]


@query
def sipw_gbm(x: Facts) -> DataFrame:
    return boosted.sipw(cells.from_facts(x, features.groups_of(x)), boosted_propensity(x)).drop("method")


@query
def match_ps_gbm_k3(x: Facts) -> DataFrame:
    return boosted.match(cells.from_facts(x, features.groups_of(x)), boosted_propensity(x)).drop("method")


@query
def dm_impute_t_att_gbm(x: Facts) -> DataFrame:
    return boosted.imputed(boosted_outcomes(x)).drop("method")


@query
def dr_att_gbm(x: Facts) -> DataFrame:
    # What both fits read is built before they run beside each other.
    cells.from_facts(x, features.groups_of(x))
    e, of = boosted.beside(x.cards.sparkSession, lambda: boosted_propensity(x), lambda: boosted_outcomes(x))
    return boosted.imputed(of, e).drop("method")


@query
def dml(x: Facts) -> DataFrame:
    return grams.double_learning(cells.from_facts(x, features.groups_of(x))).drop("method")


def modelled(name: str) -> None:
    def run(x: Facts) -> DataFrame:
        groups = features.groups_of(x)
        return models.estimate(features.frame(x, groups), groups, [name]).drop("method")

    run.__name__ = name
    query(run)


for _name in (*models.ESTIMATORS, *models.NETS):
    modelled(_name)


@query
def propensity_diagnostics(x: Facts) -> DataFrame:
    return models.propensity_diagnostics(cells.from_facts(x, features.groups_of(x)))


@query
def forest_diagnostics(x: Facts) -> DataFrame:
    groups = features.groups_of(x)
    return models.forest_diagnostics(features.frame(x, groups), groups)


@query
def net_report(x: Facts) -> DataFrame:
    groups = features.groups_of(x)
    return models.net_report(features.frame(x, groups), groups)


@query
def propensity_tuning(x: Facts) -> DataFrame:
    """Held-out Brier scores of boosted propensities over a small grid, pooled over cards."""
    return models.tune(features.frame(x, features.groups_of(x)), [], {"trees": [20, 50], "depth": [2, 3]})


@query
def outcome_tuning(x: Facts) -> DataFrame:
    """Held-out squared errors of boosted control outcomes over a small grid, pooled over cards and groups."""
    groups = features.groups_of(x)
    return models.tune(features.frame(x, groups), groups, {"trees": [10, 20], "depth": [2]}, profile="gbm_y")


@query
def forest_tuning(x: Facts) -> DataFrame:
    """Held-out R-loss of the causal forest for two leaf sizes, pooled over cards and groups."""
    groups = features.groups_of(x)
    return models.tune(features.frame(x, groups), groups, {"trees": [10], "leaf": [20, 60]}, profile="forest")


def effects_and_estimates(x: Facts) -> tuple[DataFrame, DataFrame]:
    """Reference effects, stored, and the estimates that need no model."""
    truth = stored(iv.reference_effects(x).select("card_a", "group_b", "late", "se_late"), "effects")
    return truth, naive(x).unionByName(naive(x, offered_only=True)).unionByName(metrics.null_baselines(truth))


def scoring(x: Facts) -> DataFrame:
    """Reference effects with their estimates, stored before they are scored."""
    truth, estimates = effects_and_estimates(x)
    return stored(truth.join(estimates, ["card_a", "group_b"], "left"), "scoring")


@query
def null_baselines(x: Facts) -> DataFrame:
    return metrics.null_baselines(iv.reference_effects(x))


@query
def enrich_pairs(x: Facts) -> DataFrame:
    """The same join with its checks: every method has every pair once."""
    return metrics.enrich(*effects_and_estimates(x))


@query
def samplewise_errors(x: Facts) -> DataFrame:
    return metrics.samplewise(scoring(x))


@query
def method_scores(x: Facts) -> DataFrame:
    return metrics.method_scores(scoring(x))


@query
def bh_adjusted(x: Facts) -> DataFrame:
    out = fdr.benjamini_hochberg(iv.reference_effects(x).select("card_a", "group_b", "p_value"), "p_value", [F.lit(0)], ["card_a", "group_b"])
    return out.drop("reject")


@query
def bh_reject(x: Facts) -> DataFrame:
    p = iv.reference_effects(x).select("card_a", "group_b", "p_value")
    return fdr.benjamini_hochberg(p, "p_value", ["card_a"], ["group_b"], alpha=0.3).drop("q")


@query
def bootstrap_intervals(x: Facts) -> DataFrame:
    return resample.bootstrap_intervals(scoring(x), n_boot=BOOT)


@query
def row_bootstrap(x: Facts) -> DataFrame:
    return resample.bootstrap_intervals(scoring(x), n_boot=BOOT, cluster=None)


@query
def significance_matrix(x: Facts) -> DataFrame:
    return resample.significance_matrix(scoring(x), n_boot=BOOT, one_sided=False)


@query
def disagreement_filter(x: Facts) -> DataFrame:
    return resample.disagreements(resample.significance_wide(resample.significance_matrix(scoring(x), n_boot=BOOT, one_sided=False)))


@query
def rank_separation(x: Facts) -> DataFrame:
    return resample.rank_separation(stored(iv.reference_effects(x), "effects"), n_boot=BOOT)


@query
def rank_separation_fdr(x: Facts) -> DataFrame:
    """The pairs whose two-sided tails are rejected under false-discovery control."""
    return resample.rank_separation(stored(iv.reference_effects(x), "effects"), n_boot=BOOT, fdr=0.3)


@query
def rsc_sensitivity(x: Facts) -> DataFrame:
    return resample.rsc_sensitivity(scoring(x), (0.2, 0.4), n_boot=BOOT, fixed=0.5)


@query
def rank_spearman(x: Facts) -> DataFrame:
    """Rank agreement of the methods between two sets: cards with even and with odd numbers."""
    rows = scoring(x).join(F.broadcast(x.cards.select(F.col("card").alias("card_a"), "no")), "card_a")
    parts = [metrics.method_scores(rows.where(F.col("no") % 2 == i).drop("no")).withColumn("variant", F.lit(f"v{i}")) for i in (0, 1)]
    return metrics.rank_spearman(parts[0].unionByName(parts[1]))


@query
def value_per_quanta(x: Facts) -> DataFrame:
    return metrics.value_per_quanta(iv.reference_effects(x).withColumn("size", F.abs("late")), "se_late", "size")


@query
def set_summary(x: Facts) -> DataFrame:
    rows = iv.reference_effects(x).select("card_a", "group_b", F.when(F.substring_index("card_a", "#", -1).cast("int") % 2 == 0, "EVN").otherwise("ODD").alias("set_code"))
    return metrics.set_summary(rows)


#: Card metadata of every part, by arithmetic on its key (k) and size (s); ``list(..)`` is the engine's array.
_COLOR = "substring('WUBRG', cast(({}) % 5 as int) + 1, 1)"
_W, _V = _COLOR.format("k"), _COLOR.format("k + s")


def part_cards_sql(array: str) -> str:
    """SQL for name, colors, face, mana_cost, cmc, type_line and rarity of every part; ``array`` writes an array, such as ``array({})``."""
    several = lambda *x: array.format(", ".join(x))
    none = f"cast({array.format('')} as {'array<string>' if array.startswith('array') else 'varchar[]'})"
    types = " ".join(f"when {i} then '{t}'" for i, t in enumerate(drafts.TYPES))
    return f"""SELECT name, CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN {none} WHEN 2 THEN {several(_W, _V)} ELSE {several(_W)} END AS colors,
  CASE WHEN k % 3 = 0 THEN NULL ELSE {several(_V)} END AS face,
  CASE s % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('{{', s, '}}{{', {_W}, '}}{{', {_V}, '}}') WHEN 3 THEN concat('{{', {_W}, '/', {_V}, '}}{{X}}') WHEN 4 THEN concat('{{2/', {_W}, '}}{{2/', {_W}, '}}')
    WHEN 5 THEN concat('{{', {_W}, '/P}}{{C}}') ELSE concat('{{', s, '}} {{ ', {_V}, ' }}') END AS mana_cost,
  CASE WHEN k % 4 = 0 THEN cast(s as double) / 4 END AS cmc, concat(p_type, ' ', CASE k % 8 {types} ELSE 'Conspiracy' END, CASE WHEN s % 9 = 0 THEN ' Creature' ELSE '' END) AS type_line,
  CASE s % 5 WHEN 0 THEN 'common' WHEN 1 THEN 'uncommon' WHEN 2 THEN 'rare' WHEN 3 THEN 'mythic' END AS rarity
FROM (SELECT concat(p_name, ' ', p_partkey) AS name, p_partkey AS k, p_size AS s, p_type FROM part)"""


def part_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of every part, with the first face's colors in ``card_faces``."""
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("_tallyforge_part")
    rows = spark.sql(part_cards_sql("array({})").replace("FROM part)", "FROM _tallyforge_part)"))
    return rows.withColumn("card_faces", F.when(F.col("face").isNotNull(), F.array(F.struct(F.col("face").alias("colors")))))


@plain
def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_cards(spark, sf_dir).select("name", C.group_label(F.col("colors"), F.col("card_faces"), F.col("type_line")).alias("label"))


@plain
def mana_pips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_cards(spark, sf_dir).select("name", *[C.pips(F.col("mana_cost"), c).alias(f"pips_{c.lower()}") for c in C.COLORS], F.array_join(C.mana_symbols(F.col("mana_cost")), " ").alias("symbols"))


@plain
def mana_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = C.mana_value(F.col("cmc"), F.col("mana_cost"))
    return part_cards(spark, sf_dir).select("name", value.alias("mv"), C.mana_bucket(value).alias("bucket"), C.is_premium(F.col("rarity")).alias("premium"), C.has_type(F.col("type_line"), "Land").alias("land"))


GRID_SPACE = {"trees": [50, 100, 200], "rate": [5, 10, 20, 40], "depth": [3, 5]}


@plain
def grid_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part, the point of a search space that its key falls on, by mixed-radix digits."""
    columns, step = {}, 1
    for name in reversed(GRID_SPACE):
        values = GRID_SPACE[name]
        digit = F.expr(f"(point div {step}) % {len(values)}").cast("int")
        columns[name], step = F.element_at(F.array(*map(F.lit, values)), digit + 1), step * len(values)
    points = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % step).alias("point"))
    return points.select("p_partkey", "point", *[columns[n].alias(n) for n in GRID_SPACE])


PAGE_ROWS = 20


@plain
def page_chain_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries of linked pages of two sets, whose urls tell no order: the last part of every name."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name"), "p_partkey", (F.col("p_size") % 2).alias("set"), F.expr(f"p_partkey div {PAGE_ROWS}").alias("no"))
    made = part.groupBy("set", "no").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "name"))).alias("data"))
    # A page's link is the next number that its set has; a window a set over its thin table of numbers.
    after = F.lead("no").over(Window.partitionBy("set").orderBy("no"))
    links = made.select("set", "no", after.alias("then"))
    url = lambda c: F.when(F.col(c).isNotNull(), F.md5(F.col(c).cast("string").cast("binary")))
    return pages.cards(made.join(links, ["set", "no"]).select("set", url("no").alias("url"), url("then").alias("next_page"), "data"))
