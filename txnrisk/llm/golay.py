"""Keys of 64-bit fingerprints by the binary Golay code.

The (23, 12) Golay code is perfect: every 23-bit word lies within 3 bits of exactly
one codeword. Two words that differ in at most 2 bits therefore have a codeword
within 4 bits of both: the one nearest to a word halfway between them. The keys of
a word are the codewords within 4 bits, one or six of them.

A fingerprint is cut into segments A and B of 23 bits and C of 18. If two differ in
at most 4 bits, then either C is equal and A or B differs in at most 2 bits, or C
differs and A and B together differ in at most 3: then one of them is equal, or
both differ in at most 2. So they share a key of one of the kinds

    C and a codeword of A | C and a codeword of B | codewords of A and B | A | B
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial of the code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011
WORD, CHECK = 23, 11
REACH = 4


def remainder(word: int) -> int:
    for bit in range(WORD - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits; errors of up to REACH bits by remainder, and their number."""
    upper = np.array([remainder(m << CHECK) for m in range(1 << (WORD - CHECK))], np.int64)
    of: dict[int, list[int]] = {r: [] for r in range(1 << CHECK)}
    for n in range(REACH + 1):
        for bits in combinations(range(WORD), n):
            error = sum(1 << b for b in bits)
            of[remainder(error)].append(error)
    most = max(map(len, of.values()))
    errors = np.array([of[r] + [0] * (most - len(of[r])) for r in range(1 << CHECK)], np.int64)
    return upper, errors, np.array([len(of[r]) for r in range(1 << CHECK)])


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all codewords within REACH bits, flat, and how many each word has."""
    upper, errors, number = _tables()
    rest = upper[words >> CHECK] ^ (words & ((1 << CHECK) - 1))
    n = number[rest]
    column = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    near = np.repeat(words, n) ^ errors[np.repeat(rest, n), column]
    return near >> CHECK, n


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of unsigned 64-bit fingerprints, and the row of each."""
    bits = fingerprints.astype(np.uint64)
    a = (bits & np.uint64(0x7FFFFF)).astype(np.int64)
    b = (bits >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (bits >> np.uint64(46)).astype(np.int64)
    row = np.arange(len(bits))
    near_a, n_a = codewords(a)
    near_b, n_b = codewords(b)
    row_a, row_b = np.repeat(row, n_a), np.repeat(row, n_b)
    # every codeword of A with every one of B, row by row
    times = n_b[row_a]
    first_b = (np.cumsum(n_b) - n_b)[row_a]
    pick = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    both = np.repeat(near_a, times) << 12 | near_b[np.repeat(first_b, times) + pick]
    kinds = [c[row_a] << 12 | near_a, c[row_b] << 12 | near_b, both, a, b]
    rows = [row_a, row_b, np.repeat(row_a, times), row, row]
    return np.concatenate([v | k << 40 for k, v in enumerate(kinds)]), np.concatenate(rows)
