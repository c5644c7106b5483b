"""The net's rows: coded as they come, scored a batch at a time, with the results of one whole matrix."""

import numpy as np
import pytest

from tallyforge.operators import learners
from tallyforge.operators.learners import Coded, ThreeHeads


def rows(n):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 9, n) / rng.integers(1, 9, n), np.ones(n), rng.random(n)])
    t = (rng.random(n) < 0.3).astype(float)
    return x, t, np.column_stack([rng.integers(0, 4, n) + t, x[:, 0] / 3])


def in_batches(x, size):
    out = Coded(x.shape[1])
    for a in range(0, len(x), size):
        out.add(x[a : a + size])
    return out.done()


def test_codes_give_back_the_numbers():
    x, _, _ = rows(2500)
    kept = in_batches(x, 400)
    assert len(kept) == len(x) and np.array_equal(kept[np.arange(len(x))], x)
    assert [c.itemsize for c in kept.codes] == [1, 1, 1, 2]
    z, mean, sd = kept.scaled()
    assert np.allclose(z[np.arange(len(x))][:, [0, 1, 3]], ((x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1))[:, [0, 1, 3]])


def test_no_step_scores_more_rows_than_a_batch(monkeypatch):
    x, t, y = rows(3000)
    whole = ThreeHeads(epochs=3).fit(x, t, y)
    seen, forward = [], ThreeHeads._forward
    monkeypatch.setattr(learners, "SCORED", 700)
    monkeypatch.setattr(ThreeHeads, "_forward", lambda self, z: seen.append(len(z)) or forward(self, z))
    parts = ThreeHeads(epochs=3).fit(in_batches(x, 999), t.astype(np.int8), in_batches(y, 999))
    assert max(seen) <= 700
    assert parts.report() == pytest.approx(whole.report())
    assert all(np.allclose(a, b) for a, b in zip(parts.predict(x), whole.predict(x), strict=True))
