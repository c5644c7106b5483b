"""Vector codes, ranked search and quality rules against plain versions of their contracts."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import codes, quality, search
from tallyforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# -- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error), digest by direct distances; ``rows`` are (vec_id, vector)."""
    x = np.array([[math.floor(4096 * float(v)) for v in vector] for _, vector in rows], dtype=object)
    m = x.shape[1] // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], x[i].tolist()))[:entries]
    books = [[x[i, p * m : (p + 1) * m] for i in order] for p in range(parts)]

    def assigned(p):
        part = x[:, p * m : (p + 1) * m].astype(np.int64)
        d = ((part[:, None] - np.array(books[p], dtype=np.int64)[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            at, _ = assigned(p)
            books[p] = [np.array([sum(c) // (at == e).sum() for c in x[at == e, p * m : (p + 1) * m].T], dtype=object) if (at == e).any() else books[p][e] for e in range(len(order))]
    found = [assigned(p) for p in range(parts)]
    code = ["".join(f"{found[p][0][i]:02x}" for p in range(parts)) for i in range(len(rows))]
    return [(rows[i][0], code[i], int(sum(found[p][1][i] for p in range(parts)))) for i in range(len(rows))], hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def test_op11(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    good = [(i, v, label) for i, v, label in zip(table["vec_id"], table["embedding"], table["label"], strict=True) if v and None not in v and np.isfinite(v).all()]
    expected, digest = plain_codes([(i, v) for i, v, _ in good])
    by_label = Counter()
    for (_, _, error), (_, _, label) in zip(expected, good, strict=True):
        by_label[label] += error
    out = QUERIES["op11_vector_codes"](spark, SF).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out) == sorted((i, c, e, by_label[label]) for (i, c, e), (_, _, label) in zip(expected, good, strict=True))
    assert {r["codebooks_sha256"] for r in out} == {digest}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([3, 50, 4096, 2**22, 2**27]), st.integers(1, 12))
def test_screening_never_misses(seed, spread, m):
    """Entries in a tight cluster, far from zero, so that float32 products cannot tell them apart."""
    rng = np.random.default_rng(seed)
    centre = rng.integers(-spread, spread + 1, m)
    book = centre + rng.integers(-2, 3, (16, m))
    x = centre + rng.integers(-3, 4, (200, m))
    d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (codes.nearest(x, book) == d.argmin(axis=1)).all()
    assert codes.screened(x, book)[np.arange(200), d.argmin(axis=1)].all()


def test_codes_decode_and_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=8)], "a" if i % 2 else None) for i in range(40)]
    odd = [(100, None, "a"), (101, [], "a"), (102, [float("nan")] * 8, "a"), (103, [1.0] * 7 + [None], "b"), (104, [float("inf")] * 8, "b"), (105, [1.0] * 16, "b"), (106, [1e30] * 8, "b"), (None, [0.5] * 8, "c"), (3, rows[3][1], "a"), (3, rows[4][1], "a")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label string").withColumns({c: F.lit("own") for c in ("code", "error", "length", "vector", "_n")})
    coded, books = codes.compressed(table, parts=4)
    out = coded.collect()
    used = rows + [r for r in odd if r[0] in (None, 3)]
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in used)
    vectors = {(i, tuple(math.floor(4096 * x) for x in v)) for i, v, _ in used}
    for r in out:
        assert any(i == r["vec_id"] and int(((np.array(v) - codes.decoded(r["code"], books)) ** 2).sum()) == r["error"] for i, v in vectors)
    total = Counter()
    for r in out:
        total[r["label"]] += r["error"]
    assert all(r["label_error"] == total[r["label"]] for r in out) and set(total) == {"a", None, "c"}
    assert codes.compressed(table.limit(0))[0].count() == 0
    few, books = codes.compressed(table.where("vec_id < 3"), parts=4)
    assert few.count() == 3 and books.shape == (4, 3, 2) and few.agg(F.sum("error")).first()[0] == 0
    with pytest.raises(ValueError, match="cut into"):
        codes.compressed(table, parts=3)


def test_label_errors_without_hot_labels(spark):
    """More labels than are ever broadcast, beside one that is."""
    coded = spark.range(6000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2500).alias("label"), F.col("id").alias("error"))
    out = codes.with_label_errors(coded).groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("s"), F.min("label_error").alias("lo"), F.max("label_error").alias("hi")).collect()
    assert sum(r["n"] for r in out) == 6000 and all(r["s"] == r["lo"] == r["hi"] for r in out)


# -- ranked search


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain_search(docs, items, k=50):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(plain_terms(text)) if df[t]}
        found = []
        for i, c, n in counts:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(w * ((1_000_000_000 * c[t]) // (1_000 * c[t] + 20 * m)) for t, w in weight.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def key(row):
    return [(v is None, v or 0) for v in row]


def test_op12(spark):
    docs, bench = (pq.read_table(f"{SF}/{t}.parquet").to_pydict() for t in ("documents", "benchmark"))
    expected = plain_search(zip(docs["doc_id"], docs["text"], strict=True), zip(bench["item_id"], bench["text"], strict=True))
    assert sorted(map(tuple, QUERIES["op12_search"](spark, SF).collect())) == sorted(expected)


def test_search_cases(spark, monkeypatch):
    """Many ties, blocks of two queries, nulls, repeats, very long texts."""
    monkeypatch.setattr(search, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)] + ["Élan", "ß"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(300)] + [(None, "w1 w2"), (None, "w1 w2"), (5, "w1 w2"), (5, "w1 w2"), (900, None), (901, ""), (902, "--- !"), (903, "W1,w1." * 50_000)]
    docs += [(2000 - i, "same words w3 here") for i in range(150)]
    items = [(1, "w1 w2 W1 élan"), (2, None), (None, "same w3"), (3, "???"), (1, "w1 w2 W1 élan"), (4, "absent"), (5, "ß W9 absent here")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({c: F.lit("own") for c in ("shard", "n", "terms", "rank", "score", "_q")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("own"))
    out = [tuple(r) for r in search.ranked(table, asked).collect()]
    assert sorted(out, key=key) == sorted(plain_search(docs, items), key=key)
    assert search.ranked(table.limit(0), asked).count() == 0
    assert search.ranked(table, asked.limit(0)).count() == 0


def test_rounds_skip_shards_that_cannot_win(spark, monkeypatch):
    """Documents of two vocabularies: bisection parts them, and shards of the other one are never scored."""
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(rng.choice([f"{'ab'[i % 2]}{j}" for j in range(40)], 25))) for i in range(800)]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    sample = search.sampled(table)
    assert len(sample) == 800
    side = search.halves(np.concatenate(sample), np.repeat(np.arange(800), list(map(len, sample))), 800)
    vocabulary = [{"".join(c for c in "ab" if any(search.bucket(f"{c}{j}".encode()) == b for j in range(40) for b in s[:3]))} for s in sample]
    assert len({(s, *v) for s, v in zip(side, vocabulary, strict=True)}) <= 4
    visited = []
    scored = search.scored
    monkeypatch.setattr(search, "scored", lambda v, *a: (visited.append(v.agg(F.sum(F.size("queries"))).first()[0] or 0), scored(v, *a))[1])
    items = [(7, "a1 a2 a3 a4"), (8, "b1 b2 b3")]
    out = search.ranked(table, spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted(map(tuple, out.collect())) == sorted(plain_search(docs, items, 5))
    assert 0 < sum(visited) <= 1000, "a query visits its own half, and no more"


# -- quality rules


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_op13(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    out = {r["doc_id"]: r for r in QUERIES["op13_quality"](spark, SF).collect()}
    assert out.keys() == set(docs["doc_id"])
    for i, text in zip(docs["doc_id"], docs["text"], strict=True):
        r, plain = out[i], plain_statistics(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain
        assert r["base_failed"] == (plain[0] < 50 or 100 * plain[4] > 50 * plain[0])
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out, rules = quality.quality(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = out.join(labels.select("doc_id", "quality"), "doc_id").where(quality.held_out(F.col("doc_id")) & ~F.col("base_failed"))
    n = {(r["quality"], r["kept"]): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert rules and n.get((0, False), 0) >= 0.9 * (n.get((0, False), 0) + n.get((0, True), 0))
    assert n.get((1, True), 0) >= 0.99 * (n.get((1, False), 0) + n.get((1, True), 0))


def test_covering_finds_two_conjunctions():
    rng = np.random.default_rng(2)
    x = rng.random((6000, 4))
    bad = ((x[:, 0] >= 0.7) & (x[:, 1] < 0.3)) | (x[:, 2] >= 0.95)
    rules = quality.learned(x, ~bad, rng.random(6000) < 0.33, list("abcd"))
    hit = np.zeros(6000, dtype=bool)
    for rule in rules:
        hit |= quality.covers(rule, x)
    assert (hit == bad).mean() > 0.99 and len(rules) >= 2
    assert {c.name for r in rules for c in r} >= {"a", "b", "c"}
    noise = rng.random(6000) < 0.1
    assert quality.learned(x, ~noise, rng.random(6000) < 0.33, list("abcd")) == [], "chance is no rule"


def test_quality_cases(spark):
    junk = " ".join(f"w{i}*** x{i}###" for i in range(60))
    prose = " ".join(f"word{i} and" for i in range(60))
    docs = [(i, junk + f" {i}" if i % 2 else prose + f" {i}") for i in range(200)] + [(500, None), (501, ""), (502, " \n\t"), (503, "a b c " * 100_000), (None, prose), (None, junk), (1, junk + " 1"), (504, "ÀÉ x " * 60)]
    labels = [(i, 1 - i % 2) for i in range(150)] + [(0, 0), (2, None), (None, 1), (3, 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("n_words", "rule", "quality", "_low")})
    said = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("text", F.lit("own"))
    out, rules = quality.quality(table, said)
    rows = out.collect()
    assert len(rows) == len(docs) and rules
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert {i for i in range(200) if i % 2 == 0} <= kept and not {i for i in range(200) if i % 2} & kept
    assert sorted(r["kept"] for r in rows if r["doc_id"] is None) == [False, True]
    assert {r["doc_id"]: r["base_failed"] for r in rows if (r["doc_id"] or 0) >= 500} == {500: True, 501: True, 502: True, 503: True, 504: True}
    big = next(r for r in rows if r["doc_id"] == 503)
    assert (big["n_words"], big["n_repeat_words"]) == (300_000, 300_000)
    assert quality.quality(table.limit(0), said)[0].count() == 0
    bare, none = quality.quality(table, said.limit(0))
    assert none == [] and bare.count() == len(docs)


def test_rules_read_as_conditions(spark):
    rule = (quality.Condition(0, "n_words", True, 3.0), quality.Condition(1, "word_length", False, 2.5))
    assert quality.described([rule]) == ["n_words >= 3 and word_length < 2.5"]
    df = spark.createDataFrame([(5, 10), (5, 50), (1, 1), (0, 0)], "n_words long, word_chars long").withColumns({c: F.lit(1) for c in quality.COUNTS[2:]})
    assert [r[0] for r in df.select(quality.first_rule([rule, (quality.Condition(0, "n_words", False, 1.0),)])).collect()] == [1, None, None, 2]
