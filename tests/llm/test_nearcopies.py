"""Near copies at a similarity, against brute force."""

import random

import numpy as np
import pytest

from tallyforge.llm import nearcopies
from tallyforge.llm.simhash import shingle_hashes


def sets_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    """Component of each doc_id, and the pairs with a similarity of 0.8 and more."""
    sets, parent = {i: sets_of(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = []
    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                pairs.append((i, j))
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}, pairs


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("block", [5, nearcopies.BLOCK])
def test_near_copies(spark, block, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "LOOK", 4 * block)
    monkeypatch.setattr(nearcopies, "LARGEST", 8 * block)
    monkeypatch.setattr(nearcopies, "FLUSH", 50)
    monkeypatch.setattr(nearcopies, "CHUNK", 1000)
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(2000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for edits in (1, 2, 3, 4, 6, 9, 14):
        for _ in range(8):
            base = text(200)
            texts += [" ".join(base), edited(rng, base, edits)]
    base = text(200)
    texts += [edited(rng, base, rng.randrange(1, 4)) for _ in range(120)]
    texts += [None, "", "  ", "one two", "One TWO", "one two three", " ".join(text(9000))]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, id string, fp string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()}
    expected, pairs = brute_force(rows)
    assert all(expected[i] == expected[found[i]] for i in found), "nothing under the similarity is linked"
    met = sum(found[a] == found[b] for a, b in pairs)
    assert met >= 0.97 * len(pairs)
    assert len({found[i] for i in range(112, 232)}) == 1
    assert [found[i] for i in range(232, 238)] == [232, 232, 232, 235, 235, 237]
    assert len(found) == len(rows)


def test_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b"), (2, "c d e f g h"), (3, None)], "doc_id long, text string")
    found = sorted((r["doc_id"] or -1, r["component_id"]) for r in nearcopies.near_copies(docs).collect())
    assert found == [(-1, 4), (2, 2), (3, 3), (4, 4), (4, 4)]
    assert nearcopies.near_copies(docs.limit(0)).count() == 0


def test_pairs_inside_a_family(spark):
    """A few hundred texts of one template, mutually at about 0.7, hide pairs at 0.85."""
    rng = random.Random(7)
    base = [f"word{rng.randrange(5000)}" for _ in range(200)]
    texts = [edited(rng, base, 4) for _ in range(600)]
    texts += [edited(rng, t.split(), 3) for t in texts[::10]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()}
    expected, pairs = brute_force(rows)
    assert len(pairs) > 50 and len(set(expected.values())) > 400
    assert all(expected[i] == expected[found[i]] for i in found)
    assert sum(found[a] != found[b] for a, b in pairs) <= 0.01 * len(pairs)


def test_repeated_lines(spark):
    """A repeated line is one line of the set: it neither joins different texts nor parts similar ones."""
    rng = random.Random(11)
    body = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    line, passage, text = " ".join(f"line{i}" for i in range(9)), " ".join(f"p{i}" for i in range(20)), body()
    rows = list(enumerate([f"{' '.join([line] * 100)} {body()}", f"{' '.join([line] * 100)} {body()}", f"{text} {passage}", f"{text} {' '.join([passage] * 60)}"]))
    found = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_force(rows)[0] == {0: 0, 1: 1, 2: 2, 3: 2}


def test_recall_near_the_threshold():
    """Of over 2,000 pairs at 0.8 to 0.85 at least 0.98 meet in a table and pass the distance."""
    rng = random.Random(3)
    n = found = 0
    while n < 2_100:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([50, 100, 250]))]
        how = rng.randrange(3)
        if how == 0:
            other = edited(rng, words, max(1, round(len(words) * rng.uniform(0.017, 0.026))))
        elif how == 1:
            other = " ".join(words[: round(len(words) * rng.uniform(0.8, 0.87))])
        else:
            other = " ".join([*words, *(f"y{i}" for i in range(round(len(words) * rng.uniform(0.17, 0.24))))])
        a, b = (np.unique(shingle_hashes(t, 5)) for t in (" ".join(words), other))
        common = len(np.intersect1d(a, b, assume_unique=True))
        if not 0.8 <= common / (len(a) + len(b) - common) <= 0.85:
            continue
        n += 1
        (x, xs), (y, ys) = (tuple(np.frombuffer(p, dtype="<u4") for p in nearcopies.wide_fingerprint(s)) for s in (a, b))
        met = any(set(k) & set(m) for k, m in zip(nearcopies.ball(x, xs).tolist(), nearcopies.ball(y, ys).tolist(), strict=True))
        found += met and np.bitwise_count(x ^ y).sum() <= nearcopies.DISTANCE
    assert found >= 0.98 * n
