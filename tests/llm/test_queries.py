"""Each registered query over whole tables against a plain version of its contract."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from test_groups import contract, union_find
from test_texts import plain_pii, plain_secrets
from tokenizers import Tokenizer

from tallyforge.llm import pii, secrets
from tallyforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    table = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(table["doc_id"], table["text"], strict=True))


def run(spark, name):
    return {r[0]: r for r in QUERIES[name](spark, SF).collect()}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_op1(spark, docs):
    out = run(spark, "op1_secrets")
    assert out.keys() == docs.keys()
    for i, text in docs.items():
        base = [(k, a, b) for a, k, b in plain_secrets(text or "")]
        n = Counter(k for k, *_ in base)
        assert (out[i]["n_assign"], out[i]["n_access"], out[i]["n_hex"]) == (n["assign"], n["access"], n["hex"])
        assert out[i]["base_sha256"] == sha(base)
        every = [tuple(s.split(":")) for s in out[i]["spans"].split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(every) and sorted(every, key=lambda s: (int(s[1]), secrets.KINDS.index(s[0]))) == every


def test_op2(spark, docs):
    lang = dict(zip(*(pq.read_table(f"{SF}/documents.parquet").to_pydict()[c] for c in ("doc_id", "lang")), strict=True))
    out = run(spark, "op2_language_id")
    assert out.keys() == docs.keys() and all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 for i, r in out.items())
    assert all((out[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) for i, text in docs.items())
    judged = [i for i in out if held_out(i) and lang[i] and out[i]["lang_pred"] != "und"]
    assert sum(out[i]["lang_pred"] == lang[i] for i in judged) >= 0.95 * len(judged)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op3(spark, docs):
    out = run(spark, "op3_simhash")
    ids = sorted(docs)
    prints = [plain_fingerprint(docs[i]) for i in ids]
    root = union_find(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in out.items()} == {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, root, strict=True)}


def test_op4(spark, docs):
    out = run(spark, "op4_pii")
    for i, text in docs.items():
        base = plain_pii(text or "")
        assert out[i]["base_sha256"] == sha(base)
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        every = [tuple(s.split(":")) for s in out[i]["spans"].split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(every) and sorted(every, key=lambda s: (pii.KINDS.index(s[0]), int(s[1]))) == every


def test_op5(spark, docs):
    out = run(spark, "op5_sharding")
    for i, text in docs.items():
        data = (text or "").encode()
        assert (out[i]["size"], out[i]["text_crc32"], out[i]["law"], out[i]["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
    shards = {}
    for r in out.values():
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert set(shards) == set(range(40)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_op6(spark, docs):
    out = run(spark, "op6_toxicity")
    assert out.keys() == docs.keys()
    assert all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in out.items())


def test_op7(spark, docs):
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    expected = contract(docs.items(), zip(bench["item_id"], bench["text"], strict=True))
    out = run(spark, "op7_decontamination")
    for i, (n, hit, items, bad) in expected.items():
        r = out[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bad)


def test_op8(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = run(spark, "op8_tokens")
    for i, text in docs.items():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (len((text or "").encode()), n, n > 1024)


def test_op10(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    ids, rows = table["vec_id"], table["embedding"]
    good = [i for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(rows[i], dtype=float) / np.linalg.norm(np.array(rows[i], dtype=float)) for i in good}
    links = [(i, j) for i in good for j in good if j < i and len(rows[i]) == len(rows[j]) and unit[i] @ unit[j] >= 0.95]
    n = Counter(x for ij in links for x in ij)
    order = np.argsort(ids)
    place = {int(k): r for r, k in enumerate(order)}
    root = union_find(len(ids), [(place[i], place[j]) for i, j in links])
    out = run(spark, "op10_embeddings")
    assert {k: (r["n_links"], r["component_id"], r["kept"]) for k, r in out.items()} == {ids[i]: (n[i], (c := ids[order[root[place[i]]]]), c == ids[i]) for i in range(len(ids))}
