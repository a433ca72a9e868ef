"""An R-tree over count vectors that finds pairs of sets whose overlap can be large enough.

A set's tokens are hashed into groups; its point is the number of tokens in each
group.  Two sets share at most the sum over groups of the smaller count, and a
set shares at most that sum with any set under a tree node if the node's largest
coordinates stand for the other.  Points are packed into leaves by size and then
by the centre of their coordinates, leaves into nodes.
"""

from __future__ import annotations

import numpy as np

LEAF = 16
GROUPS = 512
FULL = np.iinfo(np.uint8).max
#: Groups of the fine point, which is kept as the sorted groups of all tokens, by differences.
FINE = 1 << 16


def point(tokens: np.ndarray) -> np.ndarray:
    """Counts by group; a full count stands for any larger one."""
    return np.minimum(np.bincount((tokens & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), FULL).astype(np.uint8)


def fine_point(tokens: np.ndarray) -> np.ndarray:
    return np.diff(np.sort((tokens >> np.uint64(32)) & np.uint64(FINE - 1)).astype(np.int32), prepend=0).astype("<u2")


def fine_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Largest possible overlap of two fine points: the sum over groups of the smaller count."""
    a, b = np.cumsum(a, dtype=np.int64), np.cumsum(b, dtype=np.int64)
    # Number the tokens of a group, so that the k-th of one meets the k-th of the other.
    rank = lambda x: np.arange(len(x)) - np.searchsorted(x, x)
    return len(np.intersect1d(a << 32 | rank(a), b << 32 | rank(b), assume_unique=True))


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of n and m tokens whose Jaccard similarity reaches ``percent``."""
    return -(-percent * (n + m) // (100 + percent))


class CountForest:
    """An R-tree for each group of points, queried all at once.

    A leaf has up to LEAF adjacent points of one group, a box above up to LEAF
    boxes; each has its points' largest coordinates, their range of sizes, and the
    largest of what they can share.  All queries go down together, level by level.
    """

    #: Pairs of a query and a box whose bounds are taken at once, and pairs that are held at once, about.
    CHUNK, HELD = 2048, 1 << 21

    def __init__(self, points: np.ndarray, sizes: np.ndarray, group: np.ndarray, most: np.ndarray | None = None, classes: np.ndarray | None = None):
        """``most``: an upper limit of what each set can share, all its tokens if None; ``classes``: their own row each if None."""
        sizes = np.asarray(sizes, np.int64)
        tilt = points.astype(np.float32) @ np.arange(GROUPS, dtype=np.float32) / np.maximum(points.sum(1, dtype=np.int64), 1)
        self.order = np.lexsort((tilt, np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.12)), group))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.group = np.unique(np.asarray(group)[self.order], return_inverse=True)[1]
        self.most = self.sizes if most is None else np.asarray(most, np.int64)[self.order]
        self.classes = np.arange(len(sizes)) if classes is None else np.asarray(classes)[self.order]
        # Each level: first and last + 1 of what is below, largest coordinates, least and largest size, largest share; and of each group its first box.
        self.levels: list[tuple[np.ndarray, ...]] = []
        owner, below = self.group, (self.points, self.sizes, self.sizes, self.most)
        while len(owner):
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            many = np.diff(np.r_[begin, len(owner)])
            if self.levels and many.max() == 1:
                break
            place = np.arange(len(owner)) - np.repeat(begin, many)
            cut = np.flatnonzero(place % LEAF == 0)
            stop = np.r_[cut[1:], len(owner)]
            below = (np.maximum.reduceat(below[0], cut), np.minimum.reduceat(below[1], cut), np.maximum.reduceat(below[2], cut), np.maximum.reduceat(below[3], cut))
            owner = owner[cut]
            self.levels.append((cut, stop, *below, np.searchsorted(owner, np.arange(self.group[-1] + 1)), np.bincount(owner)))

    def _within(self, query: np.ndarray, points: np.ndarray, at: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Which pairs can share ``need``."""
        ok = np.zeros(len(query), bool)
        for a in range(0, len(query), self.CHUNK):
            part = slice(a, a + self.CHUNK)
            least = np.minimum(self.points[query[part]], points[at[part]])
            ok[part] = (least.sum(1, dtype=np.int64) >= need[part]) | (least == FULL).any(1)  # two full counts: no bound
        return ok

    def _opened(self, first: np.ndarray, stop: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = stop - first
        return np.repeat(query, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)

    def _found(self, queries: np.ndarray, percent: int, target: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.argmax([(level[7] == 1) for level in self.levels], axis=0) if len(self.levels) > 1 else np.zeros(self.group[-1] + 1, np.int64)
        q, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            first, stop, points, low, high, share, roots, _ = self.levels[k]
            mine = queries[top[self.group[queries]] == k]
            size = self.sizes[q]
            # The smallest partner that fits needs least.
            least = np.maximum(low[at], -(-percent * size // 100))
            need = needed(least, size, percent)
            ok = np.flatnonzero((100 * high[at] >= percent * size) & (percent * low[at] <= 100 * size) & (share[at] >= need) & (self.most[q] >= need))
            ok = ok[self._within(q[ok], points, at[ok], need[ok])]
            box = np.r_[at[ok], roots[self.group[mine]]]  # a root is opened at once
            q, at = self._opened(first[box], stop[box], np.r_[q[ok], mine])
        n, m = self.sizes[q], self.sizes[at]
        need = needed(n, m, percent)
        once = target[at] & (~query[at] | (at > q))
        ok = np.flatnonzero(once & (self.classes[q] != self.classes[at]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(self.most[q], self.most[at]) >= need))
        ok = ok[self._within(q[ok], self.points, at[ok], need[ok])]
        return q[ok], at[ok]

    def pairs(self, percent: int, target: np.ndarray | None = None, query: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of points of one group and different classes that pass every bound; each pair once.

        Only pairs of a query with a target, all points being both by default.  The
        targets of a group's largest class need no query of their own.
        """
        empty = np.zeros(0, np.int64)
        if not len(self.sizes):
            return empty, empty
        target = np.ones(len(self.sizes), bool) if target is None else target[self.order]
        query = np.ones(len(self.sizes), bool) if query is None else query[self.order].copy()
        by_class = np.lexsort((self.classes, self.group))
        g, c = self.group[by_class], self.classes[by_class]
        begin = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
        many = np.diff(np.r_[begin, len(g)])
        largest = np.zeros(g[-1] + 1, np.int64)
        largest[g[begin][np.argsort(many, kind="stable")]] = c[begin][np.argsort(many, kind="stable")]
        query &= ~(target & (self.classes == largest[self.group]))
        asked = np.flatnonzero(query)
        cost = np.cumsum(np.bincount(self.group)[self.group[asked]])
        found = [self._found(part, percent, target, query) for part in np.split(asked, np.flatnonzero(np.diff(cost // self.HELD)) + 1) if len(part)]
        left, right = (np.concatenate([f[i] for f in found]) if found else empty for i in (0, 1))
        return self.order[left], self.order[right]
