"""Suffix trees of groups of suffixes: sorted suffixes, what neighbours share, and the internal nodes that follow from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Tree:
    """The tree of ``suffixes`` (rows of 32-bit letters, cut or padded to one width); suffixes of different ``group`` share nothing."""

    def __init__(self, suffixes: np.ndarray, group: np.ndarray | None = None):
        n, self.depth = suffixes.shape
        room = np.zeros((n, self.depth + self.depth % 2), np.uint64)
        room[:, : self.depth] = suffixes
        pairs = room[:, ::2] << np.uint64(32) | room[:, 1::2]
        keys = [*pairs.T[::-1]] + ([] if group is None else [group])
        self.order = np.lexsort(keys) if keys else np.arange(n)
        ranked = suffixes[self.order]
        other = ranked[1:] != ranked[:-1]
        self.shared = np.where(other.any(axis=1), other.argmax(axis=1), self.depth) if self.depth else np.zeros(max(0, n - 1), np.int64)
        if group is not None:
            g = group[self.order]
            self.shared[g[1:] != g[:-1]] = -1

    def at_depth(self, depth: int) -> np.ndarray:
        """For each suffix a number: equal for those below one node that is ``depth`` letters deep or more."""
        node = np.empty(len(self.order), np.int64)
        node[self.order] = np.cumsum(np.r_[True, self.shared < depth])[: len(node)]
        return node

    def nodes(self, depth: int) -> Iterator[tuple[int, np.ndarray]]:
        """Internal nodes ``depth`` letters deep or more: their depth, and the suffixes below."""
        opened: list[tuple[int, int]] = []
        for i, h in enumerate([*self.shared.tolist(), -1]):
            lo = i
            while opened and opened[-1][0] > h:
                d, lo = opened.pop()
                if d >= depth:
                    yield d, self.order[lo : i + 1]
            if not opened or opened[-1][0] < h:
                opened.append((h, lo))
