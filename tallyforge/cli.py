"""Command line: the commands that take a set's logs to results, and the registered queries.

    python -m tallyforge.cli build-reference-effects SET --config FILE
    python -m tallyforge.cli query NAME --data DIR [--out DIR [--csv]]
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from . import workflow
from .operators import models
from .plans.queries import QUERIES
from .session import session
from .sources.sinks import load_profiles, load_spaces


def read_methods(path: str) -> list[str]:
    """Method names from a file; blank lines and ``#`` comments are skipped."""
    with open(path, encoding="utf-8") as f:
        return [name for line in f if (name := line.split("#")[0].strip())]


def estimators() -> list[str]:
    return list(dict.fromkeys(["satt", "satt_offered", *workflow.CLOSED, *workflow.OVER_CELLS, *models.REGISTRY]))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyforge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list-estimators")
    query = sub.add_parser("query", help="run a registered query over a folder of Parquet tables")
    query.add_argument("name", choices=list(QUERIES))
    query.add_argument("--data", required=True)
    query.add_argument("--out", help="folder for the result (Parquet, or CSV with --csv)")
    query.add_argument("--csv", action="store_true")

    def command(name: str, *positional: str, split: bool = False) -> argparse.ArgumentParser:
        made = sub.add_parser(name)
        for p in positional:
            made.add_argument(p)
        made.add_argument("--config", required=True, help="JSON file of the workspace")
        made.add_argument("--results", help="results folder in place of the configured one")
        if split:
            made.add_argument("--split", type=int)
        return made

    effects = command("build-reference-effects", "set_code", split=True)
    effects.add_argument("--least-picked", type=int, default=500)
    effects.add_argument("--most-ratio", type=float, default=4.0)
    estimates = command("build-baseline-estimates", "set_code", "methods_path", split=True)
    estimates.add_argument("--idx", type=int)
    estimates.add_argument("--filter")
    estimates.add_argument("--profiles", help="JSON file of learner settings")
    command("extract-baseline-features", "set_code")
    command("independence-diagnostic", "set_code")
    command("instrument-diagnostic", "set_code")
    slots = command("slot-diagnostic", "set_code")
    slots.add_argument("--least-picked", type=int, default=500)
    tuning = command("hp-tuning-sample", "set_code", "profile")
    tuning.add_argument("--seed", type=int, default=0)
    tuning.add_argument("--space", help="JSON file of a search space: setting to its values, by profile")
    command("create-summary", "topic", "set_codes", "methods_path", split=True)
    return top


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    if given.command == "list-estimators":
        print("\n".join(estimators()))
        return
    spark = session()
    if given.command == "query":
        result = QUERIES[given.name](spark, given.data)
        if not given.out:
            result.show(100, truncate=False)
        elif given.csv:
            result.write.mode("overwrite").csv(given.out, header=True)
        else:
            result.write.mode("overwrite").parquet(given.out)
        return
    space = workflow.Workspace.load(spark, given.config)
    if given.results:
        space = replace(space, results_dir=given.results)
    if given.command == "build-reference-effects":
        workflow.build_reference_effects(spark, space, given.set_code, split=given.split, least_picked=given.least_picked, most_ratio=given.most_ratio)
    elif given.command == "build-baseline-estimates":
        workflow.build_baseline_estimates(spark, space, given.set_code, read_methods(given.methods_path), idx=given.idx, name_filter=given.filter, split=given.split, profiles=load_profiles(given.profiles, models.PROFILES) if given.profiles else None)
    elif given.command == "extract-baseline-features":
        workflow.extract_facts(spark, space, given.set_code)
    elif given.command == "independence-diagnostic":
        workflow.independence_diagnostic(spark, space, given.set_code)
    elif given.command == "instrument-diagnostic":
        workflow.instrument_diagnostic(spark, space, given.set_code)
    elif given.command == "slot-diagnostic":
        workflow.slot_diagnostic(spark, space, given.set_code, least_picked=given.least_picked)
    elif given.command == "hp-tuning-sample":
        workflow.tuning_sample(spark, space, given.set_code, given.profile, seed=given.seed, space_of=load_spaces(given.space, models.SPACES)[given.profile] if given.space else None)
    else:
        workflow.create_summary(spark, space, given.topic, given.set_codes.split(","), read_methods(given.methods_path), split=given.split)


if __name__ == "__main__":
    main()
