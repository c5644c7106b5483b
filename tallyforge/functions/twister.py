"""Jumping ahead in the sequence of ``random.Random``, so that a task can draw any range of it.

The generator is linear over bits: its word sequence obeys one recurrence of degree 19,937. With
``p`` the polynomial of that recurrence, the state n words on is the sum of the windows that
the set bits of ``x^n mod p`` name, so a jump costs some log2(n) squarings and not n draws.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

# Fixed values of the 32-bit generator: words, middle offset, degree, matrix, bit masks.
WORDS, MIDDLE, DEGREE, MATRIX, UPPER, LOWER = 624, 397, 19937, 0x9908B0DF, 0x80000000, 0x7FFFFFFF


def seeded(seed: int) -> np.ndarray:
    """The state's words before the first draw of ``random.Random(seed)``."""
    return np.array(random.Random(seed).getstate()[1][:WORDS], dtype=np.uint32)


def words_after(state: np.ndarray, n: int) -> np.ndarray:
    """The state's words and the ``n`` that follow, before tempering."""
    w = np.empty(WORDS + n, np.uint32)
    w[:WORDS] = state
    step = WORDS - MIDDLE
    for at in range(0, n, step):
        k = min(step, n - at)
        mixed = (w[at : at + k] & np.uint32(UPPER)) | (w[at + 1 : at + k + 1] & np.uint32(LOWER))
        w[at + WORDS : at + WORDS + k] = w[at + MIDDLE : at + MIDDLE + k] ^ (mixed >> np.uint32(1)) ^ ((mixed & np.uint32(1)) * np.uint32(MATRIX))
    return w


@lru_cache(maxsize=1)
def recurrence() -> int:
    """The polynomial of the sequence (bit i is the coefficient of x^i), found from its bits by Berlekamp and Massey's method."""
    bits = (words_after(seeded(1), 2 * DEGREE + 1)[1 : 2 * DEGREE + 1] & 1).tolist()
    now, before, length, gap, seen = 1, 1, 0, 1, 0
    for i, bit in enumerate(bits):
        seen = (seen << 1) | bit  # bit j of seen is the bit j places back
        if (seen & now).bit_count() & 1:
            kept = now
            now ^= before << gap
            if 2 * length <= i:
                length, before, gap = i + 1 - length, kept, 0
        gap += 1
        seen &= (1 << (DEGREE + 2)) - 1
    return int(bin(now)[2:].zfill(length + 1)[::-1], 2)


def reduced(a: int, p: int) -> int:
    """``a mod p`` over bits."""
    size = p.bit_length()
    while (over := a.bit_length() - size) >= 0:
        a ^= p << over
    return a


def squared(a: int) -> int:
    """The square over bits: a zero between every two."""
    return int("0".join(bin(a)[2:]), 2)


def power_of_x(n: int, p: int) -> int:
    """``x^n mod p``."""
    out = 1
    for bit in bin(n)[2:]:
        out = reduced(squared(out) << int(bit), p)
    return out


def ahead(state: np.ndarray, n: int) -> np.ndarray:
    """The state ``n`` words on."""
    if n == 0:
        return state
    chosen, w = power_of_x(n, recurrence()), words_after(state, DEGREE)
    out = np.zeros(WORDS, np.uint32)
    for i, bit in enumerate(reversed(bin(chosen)[2:])):
        if bit == "1":
            out ^= w[i : i + WORDS]
    return out


def draws(seed: int, start: int, n: int) -> np.ndarray:
    """Numbers ``start`` to ``start + n`` of ``random.Random(seed).random()``; each takes two words."""
    source = np.random.RandomState()
    source.set_state(("MT19937", ahead(seeded(seed), 2 * start), WORDS))
    return source.random_sample(n)
