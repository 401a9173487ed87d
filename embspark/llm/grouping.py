"""Suffix array by linear grouping: Lyndon-prefix groups in descending order, no recursive renaming."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (integers) in lexicographic order.

    First suffixes are grouped by their first letter. Groups are taken from the
    greatest down; each of their suffixes points to the nearest one before it in a
    lower group, and the suffixes pointed at are moved to new groups right above
    their own, those with more pointers higher. Suffixes then stand grouped by their
    Lyndon prefixes, and one pass along the pointers gives each group's order.
    """
    n = len(text) + 1
    _, names = np.unique(text, return_inverse=True)
    names = np.r_[names + 1, 0]
    place = np.argsort(names, kind="stable")
    first = np.searchsorted(names[place], names)
    order, group = place.tolist(), first.tolist()
    at = np.argsort(place, kind="stable").tolist()
    size = np.bincount(first, minlength=n + 1).tolist()
    before = [-1] * n

    end = n
    while end > 1:
        start = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(order[start:end]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = start
        if not pointed:
            continue
        by_count: dict[int, dict[int, list[int]]] = {}
        for p, k in pointed.items():
            by_count.setdefault(k, {}).setdefault(group[p], []).append(p)
        for k in sorted(by_count, reverse=True):
            for g, moved in by_count[k].items():
                rest = size[g] - len(moved)
                if rest == 0:
                    continue
                new = g + rest
                to = g + size[g]
                for p in moved:
                    to -= 1
                    a, other = at[p], order[to]
                    order[a], order[to] = other, p
                    at[other], at[p] = a, to
                for p in moved:
                    group[p] = new
                size[g], size[new] = rest, len(moved)
        # the groups below may have been split: the next one ends where this one starts

    done, free = [False] * n, list(range(n + 1))
    out = [-1] * n
    out[0], done[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return np.array(out[1:], np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix in ``order``, letters it shares with the one before it there (0 for the first)."""
    letters, n = text.tolist(), len(text)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    rank, sa, out, h = rank.tolist(), order.tolist(), [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = sa[rank[i] - 1]
            while i + h < n and j + h < n and letters[i + h] == letters[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return np.array(out, np.int64)
