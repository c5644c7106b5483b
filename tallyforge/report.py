"""LaTeX tables from small result frames, and the data behind the plots."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .operators.metrics import METRICS


def cell(value: float | None, half: float | None = None, scale: float = 100.0) -> str:
    """``value ± half`` scaled, to two digits; ``--`` where undefined."""
    if value is None or value != value:
        return "--"
    text = f"{scale * value:.2f}"
    return text if half is None or half != half else f"{text} $\\pm$ {scale * half:.2f}"


def tabular(header: list[str], rows: list[list[str]]) -> str:
    lines = [" & ".join(r) + r" \\" for r in (header, *rows)]
    return "\n".join([r"\begin{tabular}{l" + "r" * (len(header) - 1) + "}", r"\toprule", lines[0], r"\midrule", *lines[1:], r"\bottomrule", r"\end{tabular}"])


def scores_table(scores: DataFrame, intervals: DataFrame, methods: list[str] | None = None) -> str:
    """The main table: a row a method, ``value ± half width`` by metric; absent methods are skipped."""
    rows = {r["method"]: r for r in scores.join(intervals, "method", "left").collect()}
    names = [m for m in (methods or sorted(rows)) if m in rows]
    return tabular(["method", *METRICS], [[m.replace("_", r"\_"), *[cell(rows[m][k], rows[m][f"{k}_sci"]) for k in METRICS]] for m in names])


def spearman_table(rho: DataFrame) -> str:
    rows = sorted((r["metric"], r["variant_a"], r["variant_b"], r["rho"]) for r in rho.collect())
    return tabular(["metric", "a", "b", "rho"], [[m, a, b, cell(x, scale=1.0)] for m, a, b, x in rows])


def sensitivity_table(table: DataFrame) -> str:
    rows = sorted(table.collect(), key=lambda r: r["value"])
    return tabular(["value", "remaining", *METRICS], [[f"{r['value']:g}", cell(r["remaining"]), *[cell(r[m], scale=1.0) for m in METRICS]] for r in rows])
