"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are trained: one on ordinary text, one on what sets toxic text apart (words
in contexts that toxic training texts have far more often). A window is compressed with the
ordinary dictionary alone and with the toxic one put in front of it; the bytes that the toxic
dictionary saves are the window's distance. Overlapping windows cover the whole text. A
logistic curve over three figures (bytes saved in all, most in one window, number of
windows), fitted on the training rows, calibrates the score; 0.7 is the threshold.

Training takes at most about ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows (expected
numbers of a hash sample of doc_ids, one row each) with whole texts of at most ``LONGEST``
characters; this bounds what the driver gathers. Scoring reads whole texts.

Dictionaries trained on toxic texts as they are do not tell them apart: most of such a text is
like any other, and what a window saves by the toxic dictionary is within what it saves by
chance (README has figures). So the toxic dictionary is trained on those contexts only.

Defined cases: null and empty texts have one empty window, which saves nothing; without
training rows of both kinds every score is 0; of several labels of a doc_id the highest
counts; rows that repeat get equal results; an empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, read, texts_of, unit
from .langid import held_out

TOXIC_ROWS = 1_500
CLEAN_ROWS = 3_000
#: Characters of a training text at most; longer labelled texts train nothing.
LONGEST = 20_000
WINDOW = 128
STRIDE = 96
LEVEL = 9
TOXIC_BYTES = 4_096
CLEAN_BYTES = 65_536
#: A word sets toxic text apart if its share of contexts is e ** LOG_ODDS times that elsewhere.
LOG_ODDS = 2.5
LEAST_CONTEXTS = 0.005
THRESHOLD = 0.7


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = ()


def contexts(texts: list[str]) -> set[tuple[str, str, str]]:
    """Distinct words with the words before and after, so that copies add nothing."""
    found = set()
    for text in texts:
        words = ["", *(w.strip(".,;:!?|\"'()") for w in text.lower().split()), ""]
        found.update(zip(words, words[1:], words[2:], strict=False))
    return found


def trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary's bytes; the distinct samples themselves where they are too few to train."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


class Distance:
    """Bytes that the toxic dictionary saves, by window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.pair = []
        for content in (ordinary, toxic + ordinary):
            words = zstandard.ZstdCompressionDict(content.rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def figures(self, text: str) -> tuple[float, float, float]:
        data = text.lower().encode()
        plain, toxic = self.pair
        total = most = n = 0
        for at in range(0, max(1, len(data) - WINDOW + STRIDE), STRIDE):
            window = data[at : at + WINDOW]
            saved = len(plain(window)) - len(toxic(window))
            n += 1
            if saved > 0:
                total += saved
                most = max(most, saved)
        return math.log1p(total), float(most), math.log(n)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant's."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], clean: list[str]) -> Model:
    """The model from toxic and ordinary training texts."""
    if not toxic or not clean:
        return Model()
    bad, good = contexts(toxic), contexts(clean)
    a, b = (Counter(w for _, w, _ in x) for x in (bad, good))
    support = max(4, round(LEAST_CONTEXTS * len(toxic)))
    apart = {w for w, n in a.items() if w and n >= support and math.log((n + 0.5) / len(bad)) - math.log((b[w] + 0.5) / len(good)) > LOG_ODDS}
    model = Model(
        ordinary=trained(CLEAN_BYTES, [t[i : i + 400].lower().encode() for t in clean for i in range(0, len(t), 400)]),
        toxic=trained(TOXIC_BYTES, [f" {w} ".encode() for _, w, _ in sorted(bad) if w in apart]),
    )
    distance = Distance(model.ordinary, model.toxic)
    x = np.array([distance.figures(t) for t in (*toxic, *clean)])
    model.weights = tuple(logistic(x, np.repeat([1.0, 0.0], [len(toxic), len(clean)])))
    return model


def training_texts(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """Pieces of a bounded sample of toxic and ordinary texts, each once, in order of doc_id."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sizes = dict(marked.groupBy("toxic").count().collect())
    share = F.when(F.col("toxic"), min(1.0, TOXIC_ROWS / max(1, sizes.get(True, 0)))).otherwise(min(1.0, CLEAN_ROWS / max(1, sizes.get(False, 0))))
    # Bounded by TOXIC_ROWS + CLEAN_ROWS, so safe to broadcast.
    sample = marked.where(unit(F.xxhash64("doc_id", F.lit(5))) < share)
    texts = docs.select("doc_id", "text").where(F.char_length("text") <= LONGEST)
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return tuple(list(dict.fromkeys(r["text"] for r in rows if r["toxic"] == kind)) for kind in (True, False))


def toxicity(docs: DataFrame, train: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score, one row per row of ``docs``. ``train``: doc_id, text; ``labels``: doc_id, toxic."""
    model = fit(*training_texts(train, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance, weights = Distance(model.ordinary, model.toxic), np.array(model.weights)
        for batch in batches:
            if not len(weights):
                scores = np.zeros(batch.num_rows)
            else:
                x = np.array([distance.figures(t) for t in texts_of(batch)]).reshape(-1, 3)
                scores = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), read(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"))
    found = toxicity(docs, docs.where(~out), labels.where(~out))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
