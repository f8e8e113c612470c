"""An R-tree over count vectors, searched by a bound on shared tokens.

A set's hashes are dealt to groups; the counts by group are its point. Two sets
share at most the sum of coordinate minima, and a node's upper corner bounds
that sum for all points below it.
"""

from __future__ import annotations

import numpy as np

#: Coordinates of the points that the tree is built on.
COARSE = 64
#: Entries of a leaf, and children of a node.
FAN = 16
#: Most groups of the finer points, and most cells of a tree's finer points.
FINEST, CELLS = 1 << 14, 1 << 24
#: Searchers that go down the tree together.
TOGETHER = 64


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``shared`` of ``a`` and ``b`` shingles is a Jaccard similarity of 0.8 or more."""
    return 9 * shared >= 4 * (a + b)


def points(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """Each set's counts by group (a power of two): the low bits of a hash are its group."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    group = (np.concatenate(sets) & np.uint64(groups - 1)).astype(np.int64)
    return np.bincount(owner * groups + group, minlength=len(sets) * groups).reshape(-1, groups).astype(np.int32)


class CountTree:
    """Points packed by size and then by their widest coordinates, level upon level. No set is empty."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        self.coarse = points(sets, COARSE)
        self.order = self._packed(np.arange(len(sets)))
        self.levels = []
        low, high, top = self.n[self.order], self.n[self.order], self.coarse[self.order]
        while True:
            cuts = np.arange(0, len(low), FAN)
            low, high, top = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(top, cuts, axis=0)
            self.levels.append((low, high, top))
            if len(low) == 1:
                break
        self.levels.reverse()

    def _packed(self, rows: np.ndarray) -> np.ndarray:
        """Sort-tile order: by size, then halves along the coordinate that varies most."""
        rows = rows[np.argsort(self.n[rows], kind="stable")]
        done, todo = [], [rows]
        while todo:
            part = todo.pop()
            if len(part) <= FAN:
                done.append(part)
                continue
            widest = int(self.coarse[part].var(axis=0).argmax())
            part = part[np.argsort(self.coarse[part, widest], kind="stable")]
            half = -(-len(part) // (2 * FAN)) * FAN
            todo += [part[half:], part[:half]]
        return np.concatenate(done)

    def _down(self, who: np.ndarray, n: np.ndarray, coarse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(searcher, entry) pairs that the bound allows at every level."""
        nodes = np.zeros(len(who), dtype=np.int64)
        for depth, (low, high, top) in enumerate(self.levels):
            size = n[who]
            fits = (4 * low[nodes] <= 5 * size) & (5 * high[nodes] >= 4 * size)
            who, nodes, size = who[fits], nodes[fits], size[fits]
            fits = similar(np.minimum(top[nodes], coarse[who]).sum(axis=1), size, np.maximum(low[nodes], -(-4 * size // 5)))
            who, nodes = who[fits], nodes[fits]
            below = len(self.levels[depth + 1][0]) if depth + 1 < len(self.levels) else len(self.order)
            nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            who = np.repeat(who, FAN)
            who, nodes = who[nodes < below], nodes[nodes < below]
        rows = self.order[nodes]
        fits = (4 * self.n[rows] <= 5 * n[who]) & (5 * self.n[rows] >= 4 * n[who])
        who, rows = who[fits], rows[fits]
        fits = similar(np.minimum(self.coarse[rows], coarse[who]).sum(axis=1), n[who], self.n[rows])
        return who[fits], rows[fits]

    def pairs(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(searcher, entry) pairs that the bound allows, sorted: no pair that is similar is missing."""
        n = np.array([len(s) for s in sets], dtype=np.int64)
        coarse = self.coarse if sets is self.sets else points(sets, COARSE)
        groups = COARSE
        while groups < min(FINEST, int(self.n.max())) and 2 * groups * (len(sets) + len(self.sets)) <= CELLS:
            groups *= 2
        fine: list[np.ndarray] = []
        found = []
        for lo in range(0, len(sets), TOGETHER):
            who, rows = self._down(np.arange(lo, min(lo + TOGETHER, len(sets))), n, coarse)
            # The finer bound pays where few pairs are left; many are counted faster all at once.
            if groups > COARSE and 0 < len(who) * 8 <= TOGETHER * len(self.sets):
                fine = fine or [points(sets, groups), points(self.sets, groups)]
                shared = np.concatenate([np.minimum(fine[0][who[k : k + 4096]], fine[1][rows[k : k + 4096]]).sum(axis=1) for k in range(0, len(who), 4096)])
                fits = similar(shared, n[who], self.n[rows])
                who, rows = who[fits], rows[fits]
            order = np.lexsort((rows, who))
            found.append((who[order], rows[order]))
        return np.concatenate([w for w, _ in found]), np.concatenate([r for _, r in found])
