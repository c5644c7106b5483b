"""Writers of results: CSV tables, histograms, model profiles; search spaces."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def histogram_json(hist: DataFrame) -> str:
    """A pack-length histogram (one row a distinct triple) as JSON, keys ``"15,15,15"`` in numeric order."""
    rows = {r["lengths"]: r["n_drafts"] for r in hist.select("lengths", "n_drafts").collect()}
    return json.dumps({k: rows[k] for k in sorted(rows, key=lambda k: tuple(map(int, k.split(","))))}, indent=1)


def read_histogram(text: str) -> dict[tuple[int, ...], int]:
    return {tuple(map(int, k.split(","))): n for k, n in json.loads(text).items()}


def save_profiles(profiles: dict[str, dict], path: str) -> None:
    Path(path).write_text(json.dumps(profiles, indent=1, sort_keys=True), encoding="utf-8")


def load_profiles(path: str, known: dict[str, dict]) -> dict[str, dict]:
    """Profiles laid over the known ones; unknown names or settings raise."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    for name, settings in found.items():
        if name not in known or set(settings) - set(known[name]):
            raise ValueError(f"unknown profile or setting: {name} {sorted(settings)}")
    return {n: s | found.get(n, {}) for n, s in known.items()}


def load_spaces(path: str, known: dict[str, dict]) -> dict[str, dict]:
    """Search spaces of the tuner from a JSON file, in place of the known ones; unknown names, settings or empty value lists raise."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    for name, values in found.items():
        if name not in known or set(values) - set(known[name]) or not all(isinstance(v, list) and v for v in values.values()):
            raise ValueError(f"unknown or empty search space: {name} {values}")
    return known | found
