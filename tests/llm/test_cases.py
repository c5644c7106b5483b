"""Nulls, empty and long texts, repeated rows, clashing names and empty tables, for every operator and stage."""

import json

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import decontam, embeddings, langid, mixing, pii, secrets, sharding, simhash, tokens, toxicity

#: Names that the operators use for columns of their own, beside those of documents.
CLASHING = ("text_hash", "size", "fp", "root", "row", "id", "crc", "hash", "copies", "shard", "slot", "n_bytes", "key", "u", "held_out", "quality", "score", "spans", "words", "contaminated", "bucket", "kept", "source_size", "n")


@pytest.fixture(scope="module")
def docs(spark):
    prose = "the small house by the river was old and the garden behind it was wide and green in summer"
    texts = [prose, prose, None, "", "   ", "12 34 !!", "x" * 60_000, f"{prose} and " * 3_000, "\x00 é\U0001f642 ª", prose.upper()]
    rows = [(i, t, "en" if i % 3 else None, "web" if i % 2 else None) for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", "en", "web"), (None, None, None, None), (3, "", None, None), (0, prose, None, None), (0, prose, "en", "web")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    return table.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, None, 1), (7, 0, None), (None, 1, 1), (0, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the garden behind it was wide and green in summer and the river was old too"), (2, None), (None, "no id"), (4, "")], "item_id long, text string")


OPERATORS = {
    "secrets": lambda d, l, b: secrets.find_secrets(d),
    "language": lambda d, l, b: langid.identify(d, d.where(~langid.held_out(d["doc_id"]))),
    "simhash": lambda d, l, b: simhash.near_duplicates(d),
    "pii": lambda d, l, b: pii.find_pii(d),
    "sharding": lambda d, l, b: sharding.shard(d),
    "sharded": lambda d, l, b: sharding.sharded_documents(d),
    "toxicity": lambda d, l, b: toxicity.toxicity(d, d, l),
    "decontamination": lambda d, l, b: decontam.contamination(d, b),
    "tokens": lambda d, l, b: tokens.token_counts(d),
    "mixing": lambda d, l, b: mixing.mix(d, l),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_one_result(spark, docs, labels, benchmark, name):
    out = OPERATORS[name](docs, labels, benchmark)
    ids = lambda df: sorted(-1 if r[0] is None else r[0] for r in df.select("doc_id").collect())
    assert ids(out) == ids(docs)
    # Rows that repeat have equal results, but for the places that sharding gives them.
    if name not in ("sharding", "sharded", "mixing"):
        first = {str(r) for r in out.where("doc_id = 0").collect()}
        assert len(first) == 1
    none = OPERATORS[name](docs.limit(0), labels, benchmark)
    assert none.count() == 0 and none.columns == out.columns
    assert OPERATORS[name](docs, labels.limit(0), benchmark.limit(0)).count() == docs.count()


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline(spark, docs, labels, benchmark, tmp_path, empty):
    (docs.limit(0) if empty else docs.coalesce(2)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    assert set(docs.columns) <= set(out.columns)
    assert all(r["fp"] == "own fp" and r["text_hash"] == "own text_hash" and r["row"] == "own row" for r in rows)
    assert not rows if empty else rows and {r["text"] for r in rows} <= {r["text"] for r in docs.collect()}
    assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in rows), "texts without letters are rejected"


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [])] + [(5, None)] * 40
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(json.dumps(c)) for c in ("k1", "usable", "n_links", "cid", "root")})
    out = sorted(((r["vec_id"] or -1), r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(table).collect())
    assert out == sorted([(1, 1, 1), (1, 1, 1), (2, 0, 2), (-1, 0, None), (3, 0, 3), (4, 0, 4)] + [(5, 0, 5)] * 40)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0
