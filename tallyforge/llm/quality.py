"""Quality rules: base limits, then a learned decision list over text statistics.

The statistics of a text are counted in one pass over Arrow batches. A decision list is learned by
sequential covering from labelled statistics: a rule grows, one threshold at a time, by the condition of
the highest information gain on two thirds of the labelled rows; conditions at its end are pruned for as
long as that does not lower its worth on the other third; a rule that is not right often enough there ends
the list, else what it covers is taken out and the next one grows. All rules reject, and what no
rule covers is kept. The list becomes ordered ``when`` expressions over the statistics, so that it is
applied by Spark and can be read by people.

Words are runs of other than space and U+0009 to U+000D. Defined cases: null and empty texts have no words
and fail the base limits; texts are counted whole, whatever their length; rows that repeat get equal
results; labels that are null or contradict each other for a document teach nothing, and without labels
of both kinds the list is empty; an empty table gives no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, map_arrow, read, texts_of

LEAST_WORDS = 50
MOST_REPEATED = 50
#: Labelled documents that the list is learned from at most, those of least hash.
LABELLED = 20_000
#: Rows that a rule covers at least, how often it must be right on the pruning rows, and conditions it has at most.
LEAST_COVER = 5
LEAST_PRECISION = 0.9
CONDITIONS = 4
RULES = 16

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letters", "n_upper", "n_digits", "n_marks")
# The characters that count as symbols, and as marks.
SYMBOLS = "#*$%&|<>"
MARKS = "!?"

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"


@cache
def classes() -> np.ndarray:
    """For every code point which of blank, symbol, letter, upper-case letter, digit and mark it is, a bit each."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        c = chr(i)
        out[i] = (c in BLANK) | (c in SYMBOLS) << 1 | c.isalpha() << 2 | c.isupper() << 3 | c.isdigit() << 4 | (c in MARKS) << 5
    return out


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words inside three-word windows that are found twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * n_distinct + ids[1:]
    if n_distinct >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * n_distinct + ids[2:]
    _, place, times = np.unique(window, return_inverse=True, return_counts=True)
    if len(times) == len(window):
        return 0
    again = times[place] > 1
    hit = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        hit[shift : shift + len(window)] |= again
    return int(hit.sum())


def statistics(text: str) -> tuple[int, ...]:
    """The counts of a text, in the order of ``COUNTS``."""
    words = WORD.findall(text.encode())
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    kinds = np.bincount(classes()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)], minlength=64) if text else np.zeros(64, dtype=np.int64)
    of = lambda bit: int(kinds[np.arange(len(kinds)) >> bit & 1 == 1].sum())
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return len(words), len(text) - of(0), of(1), len(lines) - len(set(lines)), repeated_words(ids, len(known)), len(lines), len(known), of(2), of(3), of(4), of(5)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([statistics(t) for t in texts_of(batch)], dtype=np.int64).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, rows.T)], ["doc_id", *COUNTS])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def shares() -> dict[str, Column]:
    """What the rules look at: counts and their ratios; a ratio to nothing is 0."""
    of = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"), "word_length": of("word_chars", "n_words"), "symbols_per_word": of("n_symbols", "n_words"), "marks_per_word": of("n_marks", "n_words"), "digits_per_word": of("n_digits", "n_words"),
        "repeated_share": of("n_repeat_words", "n_words"), "distinct_share": of("n_distinct", "n_words"), "duplicate_lines": of("n_dup_lines", "n_lines"), "words_per_line": of("n_words", "n_lines"), "letter_share": of("n_letters", "word_chars"), "upper_share": of("n_upper", "n_letters"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


# -- learning ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    """A statistic (by place and name) at or above (``up``) or below a threshold."""

    at: int
    name: str
    up: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.at] >= self.threshold if self.up else x[:, self.at] < self.threshold

    def column(self, names: dict[str, Column]) -> Column:
        return names[self.name] >= self.threshold if self.up else names[self.name] < self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.up else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def best_condition(x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The condition with the highest gain: bad rows it keeps, times the bits by which they become likelier."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best: tuple[float, Condition | None] = (0.0, None)
    before = np.log2(p0 / (p0 + n0))
    for at, name in enumerate(names):
        values, place = np.unique(x[:, at], return_inverse=True)
        if len(values) < 2:
            continue
        p, n = (np.bincount(place[b], minlength=len(values)) for b in (bad, ~bad))
        # A cut lies between two neighbouring values.
        cuts = np.arange(1, len(values))
        below_p, below_n = np.cumsum(p)[:-1], np.cumsum(n)[:-1]
        for up in (True, False):
            kept_p, kept_n = (p0 - below_p, n0 - below_n) if up else (below_p, below_n)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(kept_p > 0, kept_p * (np.log2(kept_p / (kept_p + kept_n)) - before), -1.0)
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-9:
                best = float(gain[i]), Condition(at, name, up, float((values[cuts[i] - 1] + values[cuts[i]]) / 2))
    return best


def grown(x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < CONDITIONS and bad[inside].any() and not bad[inside].all():
        gain, condition = best_condition(x[inside], bad[inside], names)
        if condition is None:
            break
        rule += (condition,)
        inside &= condition.holds(x)
    return rule


def worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    inside = covers(rule, x)
    p, n = int(bad[inside].sum()), int((~bad)[inside].sum())
    return (p - n) / (p + n) if p + n else -1.0


def pruned(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on other rows; of equals the shortest."""
    return max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (worth(r, x, bad), -len(r)))


def learned(x: np.ndarray, good: np.ndarray, pruning: np.ndarray, names: list[str]) -> list[Rule]:
    """Rules that reject, in order. ``pruning`` marks the rows that rules are pruned and judged on."""
    rules: list[Rule] = []
    bad, left = ~good, np.ones(len(x), dtype=bool)
    while len(rules) < RULES:
        grow, prune = left & ~pruning, left & pruning
        if bad[grow].sum() < LEAST_COVER or not good[grow].any():
            break
        rule = grown(x[grow], bad[grow], names)
        if not rule:
            break
        rule = pruned(rule, x[prune], bad[prune])
        inside = covers(rule, x)
        judged = inside & prune
        if (bad & inside & left).sum() < LEAST_COVER or not judged.any() or bad[judged].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def described(rules: list[Rule]) -> list[str]:
    return [" and ".join(map(str, rule)) for rule in rules]


def first_rule(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that holds; null if none does."""
    names, out = shares(), F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        held = rule[0].column(names)
        for c in rule[1:]:
            held = held & c.column(names)
        out = F.when(held, i).otherwise(out)
    return out


def held_out(doc_id: Column) -> Column:
    """Rows kept apart to judge the list on."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def rules_from(counted: DataFrame, labels: DataFrame, *, labelled: int = LABELLED) -> list[Rule]:
    """A decision list from the counts of documents (a stored table) and labels (doc_id, quality); base failures teach nothing."""
    said = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_low"), F.max("quality").alias("_high")).where("_low = _high and doc_id is not null")
    rows = counted.where(~base_failed()).join(said.select("doc_id", "_low"), "doc_id").where(~held_out(F.col("doc_id")))
    names = shares()
    rows = rows.select(F.xxhash64("doc_id").alias("_key"), F.col("doc_id").cast("string").alias("_id"), (F.col("_low") >= 1).alias("_good"), *[c.alias(n) for n, c in names.items()])
    found = rows.orderBy("_key", "_id", *names).limit(labelled).collect()
    if not found:
        return []
    x = np.array([[r[n] for n in names] for r in found], dtype=float)
    good = np.array([r["_good"] for r in found])
    # The split goes by id alone, so that repeated rows stay together.
    pruning = np.array([zlib.crc32(f"prune:{r['_id']}".encode()) % 3 == 0 for r in found])
    return learned(x, good, pruning, list(names))


def judged(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (the first that holds) and kept."""
    out = counted.withColumn("base_failed", base_failed()).withColumn("rule", first_rule(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """Counts and verdicts of every document, and the rules that gave them."""
    counted = Scratch(docs.sparkSession, "quality").keep(text_statistics(docs))
    rules = rules_from(counted, labels)
    return judged(counted, rules), rules


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = quality(documents(spark, sf_dir), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
