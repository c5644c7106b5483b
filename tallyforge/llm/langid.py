"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, everything but letters becomes a space, and its 1- to 3-grams are
hashed into ``BUCKETS`` buckets an order. Counting runs in numpy on the executors over a
stratified sample of ``ROWS_PER_LANG`` labelled rows a language (expected number; fewer where
there are fewer); Spark sums the sparse counts, and the matrix of log probabilities, whose
size depends on the parameters and the number of languages only, is broadcast. Scoring
gathers a block's log probabilities bucket by bucket and sums them by document.

The score is the posterior at a temperature that lets a text count as ``EVIDENCE`` n-grams
at most, since neighbouring n-grams are far from independent.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is
everything if no labelled row is left to learn from; ties fall to the language that sorts
first; rows that repeat get equal results; an empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, map_arrow, texts_of, unit

BUCKETS = 1 << 14
ORDERS = 3
ROWS_PER_LANG = 4_000
ALPHA = 0.5
EVIDENCE = 64
UNKNOWN = "und"
#: Characters in a numpy block.
BLOCK_CHARS = 1 << 20


@cache
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out of training; one without id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets by order, each text's start, and whether it has a letter.

    All texts stand in one array, each between spaces and after a zero; an n-gram that meets
    a zero is in the bucket after the last.
    """
    coded = [np.frombuffer(f"\0 {t.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    starts = np.cumsum([0, *map(len, coded)])[:-1]
    code = np.concatenate(coded)
    is_letter = letters()[code]
    has = np.logical_or.reduceat(is_letter, starts)
    code = np.where(is_letter, code, np.uint32(32))
    code[starts] = 0
    out = []
    h = np.zeros(len(code), dtype=np.uint32)
    bad = np.zeros(len(code), dtype=bool)
    for n in range(ORDERS):
        shifted = np.zeros_like(code)
        shifted[: len(code) - n] = code[n:]
        bad |= shifted == 0
        h = (h ^ shifted) * np.uint32(0x9E3779B1) + np.uint32(n + 1)
        h ^= h >> np.uint32(15)
        bucket = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
        bucket[bad] = BUCKETS
        out.append(bucket)
    return out, starts, has


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse n-gram counts by language of a partition's labelled texts."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = texts_of(batch), batch.column("lang").to_pylist()
        for part in blocks([len(t) for t in texts], BLOCK_CHARS):
            buckets, starts, _ = grams(texts[part])
            ends = [*starts[1:], len(buckets[0])]
            for lang, a, b in zip(langs[part], starts, ends, strict=True):
                sums = total.setdefault(lang, np.zeros((ORDERS, BUCKETS + 1), dtype=np.int64))
                for n in range(ORDERS):
                    np.add.at(sums[n], buckets[n][a:b], 1) if b - a < 256 else sums[n].__iadd__(np.bincount(buckets[n][a:b], minlength=BUCKETS + 1))
    for lang, sums in total.items():
        flat = sums[:, :BUCKETS].ravel()
        at = np.nonzero(flat)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(flat[at])], ["lang", "bucket", "n"])


def learn(rows: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and log probabilities (language, order, bucket) from doc_id, text, lang."""
    rows = rows.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = dict(rows.groupBy("lang").count().collect())
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros(0), np.zeros((0, ORDERS, BUCKETS + 1))
    share = F.lit(1.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows_per_lang / sizes[lang]))).otherwise(share)
    sample = rows.where(unit(F.xxhash64("doc_id", F.lit(11))) < share).select("text", "lang")
    sums = sample.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), ORDERS * BUCKETS))
    counts[sums["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int), sums["bucket"].to_numpy(dtype=int)] = sums["n"]
    counts = counts.reshape(len(langs), ORDERS, BUCKETS) + ALPHA
    logs = np.zeros((len(langs), ORDERS, BUCKETS + 1))
    logs[:, :, :BUCKETS] = np.log(counts / counts.sum(axis=2, keepdims=True))
    return langs, np.log(np.array([sizes[x] for x in langs]) / sum(sizes.values())), logs


def scored(texts: list[str], langs: list[str], prior: np.ndarray, logs: np.ndarray) -> tuple[list[str], list[float]]:
    """The likeliest language and its tempered posterior for each text of a block."""
    buckets, starts, has = grams(texts)
    if not langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    fit = np.stack([sum(np.add.reduceat(logs[k, n][buckets[n]], starts) for n in range(ORDERS)) for k in range(len(langs))], axis=1)
    n = np.diff([*starts, len(buckets[0])]) * ORDERS
    z = fit * np.minimum(1.0, EVIDENCE / n)[:, None] + prior
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    names = [langs[k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
    return names, np.where(has, p[np.arange(len(best)), best], 0.0).tolist()


def identify(docs: DataFrame, train: DataFrame, *, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """doc_id, text_hash, lang_pred and score, one row per row of ``docs``; ``train`` has doc_id, text, lang."""
    model = docs.sparkSession.sparkContext.broadcast(learn(train, rows_per_lang))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        names: list[str] = []
        scores: list[float] = []
        for part in blocks([len(t) for t in texts], BLOCK_CHARS):
            a, b = scored(texts[part], *model.value)
            names += a
            scores += b
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "text_hash", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, f"doc_id {kind}, text_hash long, lang_pred string, score double")


def identified(docs: DataFrame, *, least: float = 0.5, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more, as they are."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.where(~held_out(F.col("doc_id")) | F.col("doc_id").isNull()), rows_per_lang))
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep: list[bool] = []
            for part in blocks([len(t) for t in texts], BLOCK_CHARS):
                keep += [name != UNKNOWN and score >= least for name, score in zip(*scored(texts[part], *model.value), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, docs.where(~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
