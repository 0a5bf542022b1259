"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit words.

Every word lies within 3 bits of exactly one codeword. A word's keys are the codewords
within 4 bits of it, one or six of them. Two words that differ in at most one bit share
a key: the nearest codeword of the one is within 4 bits of the other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH = 23
# Fixed value: a generator polynomial of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
NONE = -1


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each word by the generator: 0 for codewords, the same within a coset."""
    left = words.astype(np.int64)
    for bit in range(LENGTH - 1, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


def _errors() -> np.ndarray:
    """Per syndrome the error patterns of at most 4 bits that have it, filled with NONE."""
    table = np.full((2048, 6), NONE, dtype=np.int64)
    used = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << bit for bit in bits)
                             for bits in combinations(range(LENGTH), weight)])
        for pattern, at in zip(patterns, syndrome(patterns)):
            table[at, used[at]] = pattern
            used[at] += 1
    return table


ERRORS = _errors()


def keys(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within 4 bits: n rows of 6, filled with NONE."""
    errors = ERRORS[syndrome(words)]
    return np.where(errors == NONE, NONE, (words.astype(np.int64)[:, None] ^ errors) >> 11)
