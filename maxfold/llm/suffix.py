"""Suffix arrays by the difference cover of period 3, in numpy."""

from __future__ import annotations

import numpy as np


def _dense(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Order-preserving names 0, 1, ... of integers, and how many there are."""
    distinct, names = np.unique(values, return_inverse=True)
    return names.astype(np.int64), len(distinct)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integers that order as the pairs do; both parts are under 2**31."""
    return (a << np.int64(32)) | b


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a sequence of integers from 0 to 2**31 - 4, in lexicographic order.

    Triples at the starts that are 1 or 2 modulo 3 are sorted and named; where names repeat, the suffixes of the
    string of names are sorted by recursion. The remaining suffixes are sorted by their first letter and the rank of
    what follows, and their places among the others found by binary search in each residue class.
    """
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.zeros(n + 4, np.int64)
    s[:n] = text
    s[:n] += 1
    ones = np.arange(1, n + (n % 3 == 1), 3)  # with one more start at n, of the empty suffix, if n is 1 modulo 3
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    if s.max() < 1 << 20:
        key = (s[sample] << 42) | (s[sample + 1] << 21) | s[sample + 2]
    else:
        key = _pairs(_dense(_pairs(s[sample], s[sample + 1]))[0], s[sample + 2])
    names, distinct = _dense(key)
    if distinct < len(sample):
        order = suffix_array(names)
        ranks = np.empty(len(sample), np.int64)
        ranks[order] = np.arange(len(sample))
    else:
        ranks, order = names, np.argsort(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = ranks + 1
    rest = np.arange(0, n, 3)
    key = _pairs(s[rest], rank[rest + 1])
    by = np.argsort(key, kind="stable")
    rest, key = rest[by], key[by]
    ranked = sample[order]
    first, second = ranked[ranked % 3 == 1], ranked[ranked % 3 == 2]
    below = np.searchsorted(_pairs(s[first], rank[first + 1]), key)
    two = np.concatenate([second, rest])
    head = _pairs(s[two], s[two + 1]) if s.max() >= 1 << 15 else (s[two] << 16) | s[two + 1]
    if s.max() >= 1 << 15:
        head = _dense(head)[0]
    head = _pairs(head, rank[two + 2])
    below += np.searchsorted(head[: len(second)], head[len(second) :])
    out = np.empty(len(sample) + len(rest), np.int64)
    place = below + np.arange(len(rest))
    taken = np.zeros(len(out), bool)
    taken[place] = True
    out[place] = rest
    out[~taken] = ranked
    return out[out < n]
