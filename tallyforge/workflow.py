"""From saved draft logs of a set to its results; each function is a command of ``tallyforge.cli``.

A set's files lie in two roots, the data folder and, for files kept with the code, a second one:

    drafts/<registered name>.csv or .csv.gz   the wide log, in file order
    metadata/groups.<SET>.json                card names to groups
    metadata/metadata.<SET>.json              card attributes, an object by name

Paths go through Spark's file systems, so the roots can be remote. Results are Parquet tables
under ``results_dir``; ``ref[.split<N>].<SET>`` has the reference effects, ``estimates[.split<N>].<SET>``
the estimates by method and card.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cards as C
from .operators import balance, boosted, cells, estimators, exclusion, facts, features, iv, models, neighbours
from .sources import drafts, ingest, manifest
from .sources.store import changed_at, stored
from .sources.tables import Facts

#: Estimators over weighted cells of the facts, and over the frame without a model.
OVER_CELLS = models.OVER_CELLS | {"match_cov_k3": lambda x, settings: neighbours.match_covariates(x)}
CLOSED = {"dm_impute_t_att_lin": estimators.ridge_imputation}


@dataclass
class Workspace:
    """Folders, and which log belongs to a set. ``registry``: set code to the log's name; others are named by the code."""

    data_dir: str
    results_dir: str
    committed_dir: str | None = None
    registry: dict[str, str] = field(default_factory=dict)
    prefer_committed: bool = True
    fail_duplicate: bool = True

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Workspace:
        """From a JSON file with the fields of this class, or with these under ``paths``."""
        found = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return cls(**found.get("paths", found))

    def find(self, spark: SparkSession, *names: str) -> str:
        """The first of ``names`` that one of the roots holds; both holding it is an error unless told otherwise."""
        for name in names:
            roots = [r for r in (self.committed_dir, self.data_dir) if r and changed_at(spark, f"{r}/{name}")]
            if len(roots) == 2 and self.fail_duplicate:
                raise ValueError(f"{name} is in both {roots[0]} and {roots[1]}")
            if roots:
                return f"{roots[0 if self.prefer_committed else -1]}/{name}"
        raise FileNotFoundError(f"none of {', '.join(names)} in {self.data_dir} or {self.committed_dir}")

    def log(self, spark: SparkSession, code: str) -> str:
        name = self.registry.get(code, f"{code}.csv").removesuffix(".gz").removesuffix(".csv")
        return self.find(spark, f"drafts/{name}.csv", f"drafts/{name}.csv.gz")

    def result(self, kind: str, code: str, split: int | None = None) -> str:
        return f"{self.results_dir}/{kind}{'' if split is None else f'.split{split}'}.{code}"


def card_table(spark: SparkSession, metadata: str, groups: str) -> DataFrame:
    """Cards with a group, and the attributes that covariates need."""
    text = spark.read.text(metadata, wholetext=True)
    entry = F.from_json("value", f"map<string,struct<{','.join(f'{n}:{t}' for n, t in (x.split(' ', 1) for x in drafts.CARD_SCHEMA.split(', ')))}>>")
    rows = text.select(F.explode(entry).alias("card", "c")).select("card", "c.*")
    cost, colors = F.col("mana_cost"), C.identity(F.col("color_identity"), F.coalesce("colors", F.get("card_faces", 0)["colors"]))
    flag = lambda c: F.array_contains(colors, c).cast("int").alias(f"is_{c}")
    known = rows.select(
        "card", *map(flag, C.COLORS), *[C.pips(cost, c).alias(f"pip_{c}") for c in C.COLORS], C.mana_value(F.col("cmc"), cost).alias("mv"),
        C.is_premium(F.col("rarity")).cast("int").alias("rare"), C.has_type(F.col("type_line"), "Land").cast("int").alias("land"), C.has_type(F.col("type_line"), "Creature").cast("int").alias("creature"),
    )
    return drafts.read_groups(spark, groups).join(known, "card", "left")


#: Format of the stored facts of a set; raise it when their columns or meaning change.
FACTS_VERSION = 1
FACT_TABLES = ("picks", "offers", "cards", "drafts", "lengths")


def extract_facts(spark: SparkSession, space: Workspace, code: str) -> dict[str, DataFrame]:
    """Facts of a set's log, stored under ``results_dir`` with a manifest: later commands read these and no CSV.

    They are built again when the log, the metadata or the groups have changed. Rows of a draft are those that stand
    together in the file. The write of the lengths observes how many drafts are incomplete, and warns of too many.
    """
    log, metadata, groups = space.log(spark, code), space.find(spark, f"metadata/metadata.{code}.json"), space.find(spark, f"metadata/groups.{code}.json")
    source = manifest.state_of(spark, log, metadata, groups)
    at = lambda name: f"{space.result('facts', code)}/{name}"
    if not all(manifest.fresh(spark, at(n), n, FACTS_VERSION, source) for n in FACT_TABLES):
        save = lambda name, df, **more: manifest.save(df, at(name), name, FACTS_VERSION, source=source, **more)
        picks, offers, ids = ingest.log_tables(drafts.read_log(spark, log, located=True))
        picks = save("picks", picks)
        save("offers", offers)
        save("cards", card_table(spark, metadata, groups), checks={"no_name": F.col("card").isNull()})
        save("drafts", ids)
        save("lengths", facts.lengths(picks), facts={"n_drafts": F.count_if("reached"), "n_incomplete": F.count_if(F.expr("reached and not complete"))})
        seen = manifest.manifest(spark, at("lengths"))["observed"]
        if seen["n_incomplete"] > facts.ALARM * seen["n_drafts"]:
            warnings.warn(f"{seen['n_incomplete']} of {seen['n_drafts']} drafts of {code} are incomplete", stacklevel=2)
    return {n: manifest.load(spark, at(n), n, FACTS_VERSION) for n in FACT_TABLES}


def set_facts(spark: SparkSession, space: Workspace, code: str, *, split: int | None = None, upper: bool = False) -> Facts:
    """The stored facts of a set. ``split`` seeds one draw a draft in file order; one half of the drafts is kept, ``upper`` the other."""
    found = extract_facts(spark, space, code)
    x = Facts(found["picks"], found["offers"], found["cards"], {"drafts": found["lengths"]})
    if split is None:
        return x
    half = stored(facts.split_in_order(found["drafts"], split).where(F.col("half") == int(upper)).select("draft_id"), "half")
    out = ingest.half_of(x, half)
    return Facts(stored(out.picks, "picks"), stored(out.offers, "offers"), out.cards, {"drafts": found["lengths"].join(half, "draft_id", "left_semi")})


def build_reference_effects(spark: SparkSession, space: Workspace, code: str, *, split: int | None = None, least_picked: int = 500, most_ratio: float = 4.0) -> DataFrame:
    """Effects of the cards that are taken often enough, over the lower half of the drafts if ``split`` is given."""
    x = set_facts(spark, space, code)
    chosen = facts.treatment_selector(facts.pick_stats(x), least_picked=least_picked, most_ratio=most_ratio).select(F.col("card_name").alias("card_a"))
    half = x if split is None else set_facts(spark, space, code, split=split)
    out = iv.reference_effects(half).join(F.broadcast(chosen), "card_a", "left_semi")
    path = space.result("ref", code, split)
    out.select(F.lit(code).alias("set_code"), *out.columns).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def build_baseline_estimates(spark: SparkSession, space: Workspace, code: str, methods: list[str], *, idx: int | None = None, name_filter: str | None = None, split: int | None = None, profiles: dict[str, dict] | None = None) -> DataFrame:
    """Estimates of ``methods`` for the pairs of the reference effects, over the upper half of the drafts if ``split`` is given.

    ``idx`` takes one card, by its place among the sorted ones whose name holds ``name_filter``; only its part of the table is written.
    """
    pairs = spark.read.parquet(space.result("ref", code, split)).select("card_a", "group_b")
    if idx is not None:
        names = sorted(r[0] for r in pairs.select("card_a").distinct().collect())
        names = [n for n in names if name_filter is None or name_filter in n]
        if idx >= len(names):
            return spark.createDataFrame([], "method string, card_a string, group_b string, value double")
        pairs = pairs.where(F.col("card_a") == names[idx])
    x = set_facts(spark, space, code, split=split, upper=True)
    groups = features.groups_of(x)
    wanted = F.broadcast(pairs.select("card_a").distinct())
    frame = features.frame(x, groups).join(wanted, "card_a", "left_semi")
    unknown = set(methods) - {"satt", "satt_offered", *CLOSED, *OVER_CELLS, *models.REGISTRY}
    if unknown:
        raise ValueError(f"unknown estimators {sorted(unknown)}")
    parts = [estimators.naive(x, offered_only=m == "satt_offered") for m in methods if m in ("satt", "satt_offered")]
    parts += [CLOSED[m](frame, groups) for m in methods if m in CLOSED]
    summed, trees = [m for m in methods if m in OVER_CELLS], [m for m in methods if m in models.BOOSTED]
    if summed or trees:
        counted = cells.only(cells.from_facts(x, groups), wanted)
        parts += [OVER_CELLS[m](counted, (profiles or models.PROFILES)["logit"]) for m in summed]
    if trees:
        parts.append(boosted.estimates(counted, lambda: cells.only(cells.from_facts(x, groups, tuple(features.covariates(frame))), wanted), trees, profiles or models.PROFILES))
    if fitted := [m for m in methods if m in models.ESTIMATORS or m in models.NETS]:
        parts.append(models.estimate(frame, groups, fitted, profiles))
    out = parts[0].select("method", "card_a", "group_b", "value")
    for more in parts[1:]:
        out = out.unionByName(more.select(*out.columns))
    out = stored(out.join(F.broadcast(pairs), ["card_a", "group_b"], "left_semi"), "estimates")
    path = space.result("estimates", code, split)
    # Only the methods and cards at hand are replaced, so that cards can be estimated one by one.
    out.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("method", "card_a").parquet(path)
    return out


def independence_diagnostic(spark: SparkSession, space: Workspace, code: str) -> DataFrame:
    """Balance of the instrument over the history pack, for the cards of the reference effects."""
    cards = spark.read.parquet(space.result("ref", code)).select("card_a").distinct()
    return written(spark, balance.balance(set_facts(spark, space, code)).join(F.broadcast(cards), "card_a", "left_semi"), space.result("independence", code))


def exclusion_diagnostic(spark: SparkSession, space: Workspace, code: str, pairs: DataFrame, kind: str) -> DataFrame:
    x = set_facts(spark, space, code)
    groups = features.groups_of(x)
    out = exclusion.matched_contrast(exclusion.sparse_buckets(x, groups), groups).join(F.broadcast(pairs), ["card_a", "group_b"], "left_semi")
    return written(spark, out.select(F.lit(code).alias("set_code"), *out.columns), space.result(kind, code))


def instrument_diagnostic(spark: SparkSession, space: Workspace, code: str) -> DataFrame:
    """Exact-match exclusion contrast for the pairs of the reference effects."""
    pairs = spark.read.parquet(space.result("ref", code)).select("card_a", "group_b")
    return exclusion_diagnostic(spark, space, code, pairs, "exclusion_diagnostic")


def slot_diagnostic(spark: SparkSession, space: Workspace, code: str, *, least_picked: int = 500, most_rate: float = 0.3) -> DataFrame:
    """The same contrast for rare cards that are seldom taken, with every group."""
    x = set_facts(spark, space, code)
    pairs = facts.slot_selector(facts.pick_stats(x), x.cards, least_picked=least_picked, most_rate=most_rate).select("card_a", "group_b")
    return exclusion_diagnostic(spark, space, code, pairs, "slot_diagnostic")


def tuning_sample(spark: SparkSession, space: Workspace, code: str, profile: str, *, seed: int, space_of: dict[str, list] | None = None) -> DataFrame:
    """Held-out losses of one random point of a profile's grid, for the cards of the reference effects."""
    cards = spark.read.parquet(space.result("ref", code)).select("card_a").distinct()
    x = set_facts(spark, space, code)
    groups = features.groups_of(x)
    frame = features.frame(x, groups).join(F.broadcast(cards), "card_a", "left_semi")
    points = models.random_grid(space_of or models.SPACES[profile], 1, seed)
    return written(spark, models.tuned(frame, groups, profile, points), space.result(f"tuning.{profile}.{seed}", code))


def create_summary(spark: SparkSession, space: Workspace, topic: str, codes: list[str], methods: list[str], *, split: int | None = None) -> DataFrame:
    """Effects of several sets with one column for each method.

    A method that lacks a pair or has one twice is an error, found by the pass that writes the summary; the summary that was there then stays.
    """
    out, given = None, [f"_n_{m}" for m in methods]
    for code in codes:
        effects = spark.read.parquet(space.result("ref", code, split))
        effects = effects.drop(*[c for c in effects.columns if c in ("GSP", "LD") or c.startswith("Unnamed")])
        if clash := set(methods) & set(effects.columns):
            raise ValueError(f"columns {sorted(clash)} are there already")
        if methods:
            found = spark.read.parquet(space.result("estimates", code, split)).where(F.col("method").isin(methods))
            one = lambda m: F.col("method") == m
            wide = found.groupBy("card_a", "group_b").agg(*[F.first(F.when(one(m), F.col("value")), ignorenulls=True).alias(m) for m in methods], *[F.count_if(one(m)).alias(n) for m, n in zip(methods, given)])
            effects = effects.join(wide, ["card_a", "group_b"], "left").fillna(0, given)
        out = effects if out is None else out.unionByName(effects.select(*out.columns))
    path = f"{space.results_dir}/{topic}"
    checks = {f"{m} lacks": F.col(n) == 0 for m, n in zip(methods, given)} | {f"{m} repeats": F.col(n) > 1 for m, n in zip(methods, given)}
    manifest.publish(out, path, checks if methods else None, drop=given)
    return spark.read.parquet(path)


def written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
