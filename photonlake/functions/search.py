"""Searches inside sorted arrays of a task."""

from __future__ import annotations

import numpy as np


def first_at_least(a: np.ndarray, start: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each k the first place >= start[k] where `a` is at least least[k], or len(a): maxima over 2^j places are skipped from
    the largest j down."""
    tops = [a]
    while 2 << (len(tops) - 1) <= len(a):
        m, step = tops[-1], 1 << (len(tops) - 1)
        tops.append(np.maximum(m[:-step], m[step:]))
    at = start.astype(np.int64).copy()
    for j in range(len(tops) - 1, -1, -1):
        while True:
            going = np.flatnonzero(at + (1 << j) <= len(a))
            going = going[tops[j][at[going]] < least[going]]
            at[going] += 1 << j
            if j + 1 < len(tops) or not len(going):
                break
    return np.minimum(at, len(a))


def path_ends(nxt: np.ndarray) -> np.ndarray:
    """Where the path from each place ends, if nxt[i] > i is the next place and len(nxt) says that there is none."""
    n = len(nxt)
    end = np.where(nxt < n, nxt, np.arange(n))
    while True:
        further = end[end]
        if np.array_equal(further, end):
            return end
        end = further
