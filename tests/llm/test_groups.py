"""Operators over pairs, groups and whole tables, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_nearcopies import brute_force

from tallyforge.llm import decontam, embeddings, mixing, sharding, simhash, toxicity
from tallyforge.llm.common import Scratch
from tallyforge.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, shard string, rank int"


def docs_of(spark, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, "x", 1) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], DOCS)


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("small", [0, 10_000])
def test_components(spark, small, monkeypatch):
    monkeypatch.setattr("tallyforge.llm.components.SMALL_EDGES", small)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 300) if i % 50] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)] + [(700, 701 + i) for i in range(80)]
    rng.shuffle(links)
    edges = spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long").repartition(5)
    found = {r["node"]: r["root"] for r in connected_components(edges, Scratch(spark, "t")).collect()}
    expected = union_find(800, links)
    assert set(found) == {x for ab in links for x in ab if ab[0] != ab[1]}
    by_root = {}
    for node, root in found.items():
        by_root.setdefault(root, set()).add(expected[node])
    assert all(len(v) == 1 for v in by_root.values()) and len(by_root) == len({expected[x] for x in found})


@pytest.mark.parametrize("hot", [1024, 3])
def test_fingerprint_links(spark, hot):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for base in list(prints)[:30]:
        for n in (1, 2, 2, 2, 3):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), n)))
    base = rng.getrandbits(64)
    prints |= {base ^ (i << 5) for i in range(40)} | {0, 1, (1 << 63) | 1, (1 << 64) - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    found = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(table, Scratch(spark, "t"), hot).collect()}
    every = sorted(prints)
    assert found == {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(every) for b in every[:i] if (a ^ b).bit_count() <= 2}


def test_simhash_documents(spark):
    base = "one two three four five six seven eight nine ten eleven twelve " * 30
    texts = [None, "", " \n ", base, base, base.upper(), "alone words here", "alone words here", "single"]
    docs = docs_of(spark, texts)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6, 8: 8}
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == [0, 3, 6, 8]
    again = docs.unionAll(docs)
    assert sorted(r["doc_id"] for r in simhash.deduplicated(again).collect()) == [0, 3, 6, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def contract(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = words(t)
        for n in [min(13, len(w))] * bool(w):
            for j in range(len(w) - n + 1):
                windows.setdefault(n, {}).setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n, by in windows.items():
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in by:
                    found |= by[tuple(w[j : j + n])]
                    hit |= set(range(j, j + n))
        out[i] = len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "cé", "Dd", "É", "e5", "the"])
    text = lambda n: " ".join(word() + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 14, 13, 12, 7, 5, 40])] + [(7, None), (8, ""), (9, "..."), (3, text(20))]
    items += [(40 + i, items[0][1].upper()) for i in range(3)]
    docs = [(i, " ".join([text(rng.randint(0, 60)), rng.choice(items)[1] or "", text(rng.randint(0, 60))])) for i in range(60)] + [(90, None), (91, ""), (92, "!!!")]
    table = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, len int, hash string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontam.contamination(table, bench).collect()}
    expected = contract(docs, items)
    assert found == expected
    kept = {r["doc_id"] for r in decontam.decontaminated(table, bench).collect()}
    assert kept == {i for i, e in expected.items() if not e[3]}


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"]) for r in decontam.contamination(docs, bench).collect()) == [(1, 3, 0), (1, 3, 0), (2, 0, 0)]
    assert decontam.contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def water_fill(sizes, weights, cap=3):
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        level = (total - sum(cap * sizes[i] for i in capped)) / max(1, sum(weights[i] for i in free))
        over = {i for i in free if weights[i] * level > cap * sizes[i]}
        if not over:
            return [cap * s if i in capped else weights[i] * level for i, s in enumerate(sizes)]
        capped |= over


@pytest.mark.parametrize("per_bin", [4096, 5])
def test_mixing(spark, per_bin, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BIN", per_bin)
    rng = random.Random(7)
    names = ["big", "é", "a", None, "tiny", "zero"]
    rows = [(i, "w " * rng.randint(0, 40), rng.choices(names[:5], [60, 10, 20, 8, 2])[0]) for i in range(400)] + [(900, None, "zero"), (901, "", "zero"), (5, "w w", "a"), (5, "w w", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    order = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    target = dict(zip(order, water_fill([sizes[n] for n in order], [(5, 2, 1)[i % 3] for i in range(6)]), strict=True))
    for name in names:
        mine = [r for r in out if r["source"] == name]
        assert all(r["source_size"] == sizes[name] and r["target"] == pytest.approx(target[name]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[name]) <= 1
        assert all(r["taken"] <= 3 * r["size"] and r["epochs"] * r["size"] <= r["taken"] <= (r["epochs"] + 1) * r["size"] for r in mine)
    key = lambda rs: sorted((r["doc_id"], r["size"], r["taken"]) for r in rs)
    assert key(out) == key(mixing.mix(docs.repartition(7)).collect())
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sharding(spark):
    rng = random.Random(8)
    texts = [None, "", "é"] + [rng.choice(["a", "bb", "same text"]) * rng.randint(1, 9) for _ in range(500)]
    docs = docs_of(spark, texts).unionAll(docs_of(spark, texts[:7]))
    out = sharding.shard(docs).collect()
    n = len(texts) + 7
    assert sorted(r["doc_id"] for r in out) == sorted([*range(len(texts)), *range(7)])
    shards = {}
    for r in out:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1 and len(shards) == 40 and n == sum(map(len, shards.values()))
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    whole = sharding.sharded_documents(docs)
    assert whole.count() == n and {"shard", "slot", "rank"} <= set(whole.columns)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_communication_matrix():
    sizes, shards = [50, 0, 7, 43], [25, 25, 25, 25]
    m = sharding.communication_matrix(sizes, shards, 1)
    assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == shards
    rng = np.random.default_rng(0)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert np.mean(draws) == pytest.approx(6, abs=0.1) and np.var(draws) == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, rel=0.1)
    assert sharding.hypergeometric(rng, 10**12, 10**12, 10**9) == pytest.approx(5 * 10**8, rel=1e-3)


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 16))
    rows = [b + rng.standard_normal(16) * s for b in base for s in (0, 0.02, 0.1, 0.3)] + [base[0]] * 5
    rows = [list(map(float, r)) for r in rows] + [[0.0] * 16, None, [], [float("nan")] * 16, [1.0] * 4, [2.0] * 4, [None] + [1.0] * 15, [1e300] * 16, [1e-300] * 16]
    table = spark.createDataFrame([(i, r, 1) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, n int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(table).collect()}
    ok = [i for i, r in enumerate(rows) if r and None not in r and np.isfinite(r).all() and any(r)]
    unit = {i: embeddings.units(np.array([rows[i]]))[0] for i in ok}
    links = [(a, b) for a in ok for b in ok if a < b and len(rows[a]) == len(rows[b]) and unit[a] @ unit[b] >= 0.95]
    root = union_find(len(rows), links)
    n = [sum(i in ab for ab in links) for i in range(len(rows))]
    assert found == {i: (n[i], root[i]) for i in range(len(rows))}
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_vector_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    monkeypatch.setattr(embeddings, "TILE", 16)
    monkeypatch.setattr(embeddings, "LEAF", 30)
    rng = np.random.default_rng(9)
    hot = rng.standard_normal(24)
    rows = [hot + rng.standard_normal(24) * 0.02 for _ in range(150)] + list(rng.standard_normal((200, 24)))
    table = spark.createDataFrame([(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(table).collect()}
    assert all(found[i] == (149, 0) for i in range(150)) and all(found[i] == (0, i) for i in range(150, 350))


def test_toxicity(spark):
    rng = random.Random(3)
    mild = ["house", "garden", "river", "walking", "morning", "table", "window", "paper", "yellow", "slowly"]
    bad = ["idiot", "scumbag", "worthless", "pathetic"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = [rng.choice(mild) for _ in range(80)]
        for _ in range(6 * toxic):
            words[rng.randrange(80)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, None if i % 7 == 3 else int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    train = docs.where("doc_id % 3 <> 1")
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, train, table.where("doc_id % 3 <> 1")).collect()}
    assert all((found[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in range(400) if i % 3 == 1)
    assert found[900] == found[901] < 0.5
    assert {r["score"] for r in toxicity.toxicity(docs, train, table.limit(0)).collect()} == {0.0}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    spark.read.parquet(f"{src}/documents.parquet").createOrReplaceTempView("documents")
    docs = spark.table("documents")
    docs.unionAll(docs.limit(3)).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{src}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    sf_dir, now = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf_dir)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{i}")
        before, now = now, spark.read.parquet(f"{tmp_path}/out{i}")
        ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
        if name == "simhash_near_dedup":
            expected, _ = brute_force([(r["doc_id"], r["text"]) for r in before.dropDuplicates(["doc_id"]).collect()])
            assert ids(now) == sorted(set(expected.values())), "one row of each group, and every group, stays"
        if name == "benchmark_decontamination":
            expected = contract([(r["doc_id"], r["text"]) for r in before.collect()], [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()])
            assert ids(now) == sorted(i for i, e in expected.items() if not e[3])
        if name == "sharding":
            assert ids(now) == ids(before)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_names_may_clash(spark):
    """Input columns named like the operators' own keep their values."""
    rows = [(i % 40, f"some words {i % 40}", "s", "mine", f"c{i % 40}", i % 40) for i in range(45)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, crc string, size long").withColumn("copies", F.lit("x")).withColumn("row", F.lit("y")).withColumn("fp", F.lit("z")).withColumn("text_hash", F.lit(1))
    out = sharding.sharded_documents(docs)
    key = lambda d: sorted(map(str, d.select(*docs.columns).collect()))
    assert key(out) == key(docs) and out.select("shard", "slot").distinct().count() == 45
    assert {str(r) for r in key(mixing.mixed_documents(docs))} <= set(key(docs))
    assert set(key(simhash.deduplicated(docs))) <= set(key(docs))


@pytest.mark.parametrize("shared", [100_000, 0])
def test_repeated_rows_are_dealt_out(spark, shared, monkeypatch):
    monkeypatch.setattr(sharding, "BROADCAST_REPEATS", shared)
    monkeypatch.setattr(sharding, "ROWS_PER_PART", 5)
    docs = spark.createDataFrame([(1, "same", "a")] * 150 + [(i, f"text {i}", "b") for i in range(100)] + [(None, None, "c")] * 3, "doc_id long, text string, kind string")
    out = sharding.sharded_documents(docs).collect()
    assert sorted(str(r[:3]) for r in out) == sorted(str(tuple(r)) for r in docs.collect())
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} <= {6, 7}
    assert len({r["shard"] for r in out if r["doc_id"] == 1 and r["kind"] == "a"}) > 25
