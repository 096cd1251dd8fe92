"""Signature trees over sets of 64-bit hashes, and the dual traversal that joins them.

A node holds the OR of its sets' bitmaps, the range of their sizes and the
largest number of elements that share a bit with another of their own set.  For
sets x and y below nodes A and B

    |x & y| <= popcount(A.bits & B.bits) + min(A.excess, B.excess)

so a pair of nodes in which this can't reach the overlap that the smallest sizes
need is dropped with everything below it.  Sets already known to be connected
aren't compared again: the result is a spanning forest of the links.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
STEP = 256
BATCH_BYTES = 16 << 20


class Forest:
    """Union-find; the root is the least index."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        return np.fromiter((self.find(i) for i in range(len(self.up))), np.int64, len(self.up))


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common elements of two sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x & y| >= percent * |x | y|."""
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < percent * large:
        return False
    both = overlap(x, y)
    return 100 * both >= percent * (small + large - both)


class Tree:
    """Levels from leaves (single sets) to the root; ``order`` maps leaves to the given sets."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        size = np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort((size, [s[0] for s in sets]))
        shift = np.uint64(64 - bits.bit_length() + 1)
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        flags = np.zeros(bits, bool)
        for row, k in enumerate(self.order):
            on = (sets[k] >> shift).astype(np.int64)
            flags[on] = True
            maps[row] = np.packbits(flags)
            flags[on] = False
        maps = maps.view(np.uint64)
        size = size[self.order]
        self.levels = [(maps, size, size, size - np.bitwise_count(maps).sum(1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1:
            m, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))

    def uniform(self, component: np.ndarray) -> list[np.ndarray]:
        """Per level and node the component that all sets below it are in, or -1."""
        out = [component[self.order]]
        while len(out[-1]) > 1:
            at = np.arange(0, len(out[-1]), FANOUT)
            lo, hi = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(lo == hi, lo, -1))
        return out


def _bits(sets: list[np.ndarray]) -> int:
    longest = max(len(s) for s in sets)
    return min(1 << 15, max(256, 1 << (4 * longest - 1).bit_length()))


def _survivors(left: Tree, right: Tree, level: int, a: np.ndarray, b: np.ndarray, own: list[np.ndarray], other: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    ml, lol, hil, exl = left.levels[level]
    mr, lor, hir, exr = right.levels[level]
    keep = 100 * np.minimum(hil[a], hir[b]) >= percent * np.maximum(lol[a], lor[b])
    keep &= (own[level][a] != other[level][b]) | (own[level][a] < 0)
    a, b = a[keep], b[keep]
    kept = []
    step = max(1, BATCH_BYTES // (ml.shape[1] * 16))
    for k in range(0, len(a), step):
        x, y = a[k : k + step], b[k : k + step]
        most = np.bitwise_count(ml[x] & mr[y]).sum(1, dtype=np.int64) + np.minimum(exl[x], exr[y])
        kept.append((100 + percent) * most >= percent * (lol[x] + lor[y]))
    keep = np.concatenate(kept) if kept else np.zeros(0, bool)
    return a[keep], b[keep]


def _expand(a: np.ndarray, b: np.ndarray, na: int, nb: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(FANOUT)
    x = np.repeat(a[:, None] * FANOUT + steps, FANOUT, 1).reshape(-1)
    y = np.tile(b[:, None] * FANOUT + steps, (1, FANOUT)).reshape(-1)
    keep = (x < na) & (y < nb) & ((x <= y) if same else True)
    return x[keep], y[keep]


def _traverse(left: Tree, right: Tree, lsets: list[np.ndarray], rsets: list[np.ndarray], forest: Forest, shift: int, percent: int, same: bool) -> None:
    """Depth first in bounded batches, so that memory doesn't follow the number of pairs.

    Near leaves come first; whatever they link prunes the pairs that are still to come."""
    top = max(len(left.levels), len(right.levels)) - 1
    for tree in (left, right):
        while len(tree.levels) <= top:  # the smaller tree gets roots of one child
            tree.levels.append(tree.levels[-1])

    def marks() -> list[list[np.ndarray]]:
        roots = forest.roots()
        found = [left.uniform(roots[: len(lsets)]), right.uniform(roots[shift : shift + len(rsets)])]
        for x in found:
            x.extend([x[-1]] * (top + 1 - len(x)))
        return found

    (own, other), stale = marks(), False
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        if stale:
            (own, other), stale = marks(), False
        a, b = _survivors(left, right, level, a, b, own, other, percent)
        if level == 0:
            for x, y in zip(left.order[a].tolist(), right.order[b].tolist(), strict=True):
                if (not same or x != y) and forest.find(x) != forest.find(y + shift) and linked(lsets[x], rsets[y], percent):
                    stale |= forest.join(x, y + shift)
            continue
        near = np.argsort(np.abs(a - b), kind="stable")[::-1]  # the last in is the first out
        a, b = a[near], b[near]
        for k in range(0, len(a), STEP):
            stack.append((level - 1, *_expand(a[k : k + STEP], b[k : k + STEP], len(left.levels[level - 1][1]), len(right.levels[level - 1][1]), same)))


def self_join(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component index (least position) of each non-empty set."""
    forest = Forest(len(sets))
    if len(sets) > 1:
        tree = Tree(sets, _bits(sets))
        _traverse(tree, tree, sets, sets, forest, 0, percent, True)
    return forest.roots()


def cross_join(left: list[np.ndarray], right: list[np.ndarray], known: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (position in left + right) that join components beyond ``known``, the component of each set."""
    sets = [*left, *right]
    forest, first = Forest(len(sets)), {}
    for i, c in enumerate(known.tolist()):
        forest.join(i, first.setdefault(c, i))
    before = forest.roots()
    bits = _bits(sets)
    _traverse(Tree(left, bits), Tree(right, bits), left, right, forest, len(left), percent, False)
    after = forest.roots()
    return [(int(i), int(after[i])) for i in np.unique(before) if after[i] != i]
