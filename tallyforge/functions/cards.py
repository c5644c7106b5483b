"""Expressions over card metadata: labels, mana symbols, pips, mana values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.drafts import TYPES

COLORS = ("W", "U", "B", "R", "G")
#: Closed ranges; a value between two of them is in none.
MANA_VALUE_BUCKETS = (("n_mv1", 0.0, 1.0), ("n_mv2", 2.0, 2.0), ("n_mv3", 3.0, 3.0), ("n_mv4", 4.0, 4.0), ("n_mv5", 5.0, 5.0), ("n_mv6plus", 6.0, 99.0))


def group_label(colors: Column, faces: Column, type_line: Column) -> Column:
    """``<colors or C>_<first of the main types>``; without own colors the first face's count."""
    own = F.coalesce(colors, F.get(faces, 0)["colors"], F.array().cast("array<string>"))
    name = F.when(F.size(own) > 0, F.array_join(own, "")).otherwise(F.lit("C"))
    kind = F.lit("Other")
    for t in reversed(TYPES):
        kind = F.when(type_line.contains(t), t).otherwise(kind)
    return F.concat(name, F.lit("_"), kind)


def mana_symbols(cost: Column) -> Column:
    """The symbols of a mana cost such as ``{2}{W/U}``, in order."""
    return F.filter(F.transform(F.split(F.translate(F.coalesce(cost, F.lit("")), "}", "{"), "[{]"), lambda s: F.trim(s)), lambda s: s != "")


def mana_value_of_cost(cost: Column) -> Column:
    """Sum over symbols: the numeric part if there is one, nothing for X, else one."""

    def one(s: Column) -> Column:
        numeric = F.filter(F.transform(F.split(s, "/"), lambda p: p.try_cast("double")), lambda x: x.isNotNull())
        return F.when(F.size(numeric) > 0, F.get(numeric, 0)).when(s == "X", 0.0).otherwise(1.0)

    return F.aggregate(mana_symbols(cost), F.lit(0.0), lambda total, s: total + one(s))


def mana_value(cmc: Column, cost: Column) -> Column:
    return F.coalesce(cmc, mana_value_of_cost(cost))


def pips(cost: Column, color: str) -> Column:
    """How often a color is asked for; both halves of a hybrid symbol count."""
    halves = F.flatten(F.transform(mana_symbols(cost), lambda s: F.split(s, "/")))
    return F.size(F.filter(halves, lambda h: h == color))


def mana_bucket(mv: Column) -> Column:
    """The name of the bucket of a mana value; null in the gaps."""
    out = F.lit(None).cast("string")
    for name, low, high in MANA_VALUE_BUCKETS:
        out = F.when(mv.between(low, high), name).otherwise(out)
    return out


def has_type(type_line: Column, kind: str) -> Column:
    return F.coalesce(type_line.contains(kind), F.lit(False))


def is_premium(rarity: Column) -> Column:
    return F.coalesce(rarity.isin("rare", "mythic"), F.lit(False))


def identity(color_identity: Column, colors: Column) -> Column:
    """Colors a card may tap for: its identity, its colors only where that is absent."""
    known = F.array(*map(F.lit, COLORS))
    return F.array_intersect(F.coalesce(color_identity, colors, F.array().cast("array<string>")), known)
