"""Cells of a k-d tree, by which searches for close points are partitioned.

The tree is fitted to a bounded sample of the points, so clusters are cut into as many cells as they have
points for, and empty space costs nothing. A cell's bounds are those of the points in it, not of its part
of space: searches prune by them, and outliers widen one cell only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Points of a cell; points that the tree is fitted to; cells (beyond ``PER_CELL * MAX_CELLS`` points, cells grow).
PER_CELL, SAMPLE, MAX_CELLS = 256, 1 << 20, 1 << 16


@dataclass(frozen=True)
class Splits:
    """A complete binary tree: inner node i splits ``axis[i]`` at ``at[i]`` and has nodes 2i + 1 (below) and 2i + 2."""

    axis: np.ndarray
    at: np.ndarray
    depth: int

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """The leaf (from 0) of each point."""
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.axis[node]] >= self.at[node])
        return node - ((1 << self.depth) - 1)


def _split(part: np.ndarray) -> tuple[int, float]:
    """The widest axis that can be cut into parts of a quarter at least, else the axis of the evenest cut; and where."""
    best = (-1.0, 0, np.inf)
    for a in np.argsort(-np.ptp(part, axis=0), kind="stable"):
        x = part[:, a]
        middle = np.partition(x, len(x) // 2)[len(x) // 2]
        above = x[x > middle]
        for at in (middle, above.min()) if len(above) else (middle,):
            share = (x < at).mean()
            if min(share, 1 - share) >= 0.25:
                return int(a), float(at)
            best = max(best, (min(share, 1 - share), int(a), float(at)))
    return best[1], best[2]


def fit(sample: np.ndarray, points: int, per_cell: int = PER_CELL) -> Splits:
    """Splits that cut ``points`` points, distributed as the sample is, into about ``per_cell`` each."""
    cells = min(MAX_CELLS, max(1, points // per_cell))
    depth = max(0, int(np.ceil(np.log2(cells))))
    inner = (1 << depth) - 1
    axis, at, members = np.zeros(max(inner, 1), np.int64), np.full(max(inner, 1), np.inf), {0: sample}
    for node in range(inner):
        part = members.pop(node)
        if len(part) > 1:
            axis[node], at[node] = _split(part)
        below = part[:, axis[node]] < at[node]
        members[2 * node + 1], members[2 * node + 2] = part[below], part[~below]
    return Splits(axis, at, depth)


@dataclass(frozen=True)
class Cells:
    """Leaves put together to cells of enough points, and the cells' bounds under a tree of boxes."""

    splits: Splits
    cell_of_leaf: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @property
    def n(self) -> int:
        return int(self.cell_of_leaf.max()) + 1

    def home(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        return self.cell_of_leaf[self.splits.leaf(points)]

    def near(self, points: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the point, cell) for all cells whose bounds are within the squared distance of the point."""
        who, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        first = len(self.lo) // 2
        while True:
            q = points[who]
            gap = np.maximum(np.maximum(self.lo[node] - q, q - self.hi[node]), 0.0)
            close = (gap * gap).sum(axis=1) <= d2[who]
            who, node = who[close], node[close]
            if not len(node) or node[0] >= first:
                return who, node - first
            who, node = np.repeat(who, 2), np.stack([2 * node + 1, 2 * node + 2], axis=1).ravel()


def gather(splits: Splits, leaf: np.ndarray, count: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> Cells:
    """Cells of at least ``least`` points each (all points, if there are fewer), from what the leaves that aren't empty hold.

    Leaves that follow each other are neighbours as a rule, but any choice is right, as bounds are those of the points.
    """
    leaves = 1 << splits.depth
    counts = np.zeros(leaves, np.int64)
    counts[leaf] = count
    rest = counts[::-1].cumsum()[::-1]
    cell, held, cell_of_leaf = 0, 0, np.zeros(leaves, np.int64)
    for i in range(leaves):
        if held >= least and rest[i] >= least:
            cell, held = cell + 1, 0
        cell_of_leaf[i] = cell
        held += counts[i]
    cells = cell_of_leaf[leaf]
    low, high = np.full((cell + 1, lo.shape[1]), np.inf), np.full((cell + 1, lo.shape[1]), -np.inf)
    np.minimum.at(low, cells, lo)
    np.maximum.at(high, cells, hi)
    return Cells(splits, cell_of_leaf, *_boxes(low, high))


def _boxes(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A complete binary tree of boxes over the cells' bounds."""
    width = 1 << max(0, int(np.ceil(np.log2(len(lo)))))
    low, high = np.full((2 * width - 1, lo.shape[1]), np.inf), np.full((2 * width - 1, lo.shape[1]), -np.inf)
    low[width - 1 : width - 1 + len(lo)], high[width - 1 : width - 1 + len(lo)] = lo, hi
    for node in range(width - 2, -1, -1):
        low[node], high[node] = np.minimum(low[2 * node + 1], low[2 * node + 2]), np.maximum(high[2 * node + 1], high[2 * node + 2])
    return low, high


def _halved(at: np.ndarray, most: int) -> np.ndarray:
    """Places of the points in cells (a row each) of equally many, up to ``most``, halved along their widest axes; -1 fills up."""
    depth = max(0, int(np.ceil(np.log2(len(at) / most))))
    size = -(-len(at) // (1 << depth))
    member = np.full(size << depth, -1)
    member[: len(at)] = np.arange(len(at))
    for level in range(depth):
        member = member.reshape(1 << level, -1)
        p = at[member]
        x = np.take_along_axis(p, np.ptp(p, axis=1).argmax(axis=1)[:, None, None], axis=2)[..., 0]
        member = np.take_along_axis(member, np.argpartition(x, x.shape[1] // 2, axis=1), axis=1)
    return member.reshape(1 << depth, size)


def _d2(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.round(sum((p[..., a] - q[..., a]) ** 2 for a in range(p.shape[-1])), 9)


def closest(at: np.ndarray, rank: np.ndarray, k: int, per_cell: int = 64, work: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(point, neighbour): the k nearest other points of each; squared distances are rounded to 9 digits, ties go to the smaller rank.

    The cell of a point bounds the ball whose cells are then searched. ``work`` distances are held at once.
    """
    member = _halved(at, per_cell)
    size = member.shape[1]
    most = np.full(len(at), np.inf)
    if size > k:
        for lo in range(0, len(member), step := max(1, work // size**2)):
            m = member[lo : lo + step]
            d2 = _d2(at[m][:, :, None], at[m][:, None])
            d2[np.broadcast_to((m < 0)[:, None], d2.shape)] = np.inf
            d2[:, np.arange(size), np.arange(size)] = np.inf
            kth = np.partition(d2, k - 1, axis=2)[..., k - 1]
            most[m[m >= 0]] = kth[m >= 0]
    cells = Cells(Splits(np.zeros(1, np.int64), np.zeros(1), 0), np.zeros(1, np.int64), *_boxes(at[member].min(axis=1), at[member].max(axis=1)))
    found, todo = [], [np.arange(lo, min(lo + 4096, len(at))) for lo in range(0, len(at), 4096)]
    while todo:
        q = todo.pop()
        who, cell = cells.near(at[q], (np.sqrt(most[q]) + 1e-6) ** 2)
        if len(who) * size > work and len(q) > 1:
            todo += [q[: len(q) // 2], q[len(q) // 2 :]]
            continue
        there = member[cell]
        d2 = _d2(at[q[who]][:, None], at[there])
        row, col = np.nonzero((d2 <= most[q[who]][:, None]) & (there >= 0) & (there != q[who][:, None]))
        u, v = q[who[row]], there[row, col]
        order = np.lexsort((rank[v], d2[row, col], u))
        u, v = u[order], v[order]
        near = np.arange(len(u)) - np.searchsorted(u, u) < k
        found.append((u[near], v[near]))
    u, v = zip(*found, strict=True)
    return np.concatenate(u), np.concatenate(v)


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches."""
    low = np.arange(n)
    while len(u):
        a, b = low[u], low[v]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(low, low[low]):
            low = low[low]
        apart = low[u] != low[v]
        u, v = u[apart], v[apart]
    return low


def largest_share(at: np.ndarray, ids: np.ndarray, k: int) -> float:
    """The share of points in the largest component of the graph of each point's k nearest others; points without a position stand alone."""
    n = len(at)
    placed = np.flatnonzero(~np.isnan(at).any(axis=1))
    if not len(placed):
        return 1.0 / n
    order = np.argsort(ids[placed], kind="stable")
    placed = placed[order]
    # Of the points of one position, those of the k + 1 smallest ids are all that others find; the rest go with the first.
    _, spot = np.unique(at[placed], axis=0, return_inverse=True)
    by = np.argsort(spot.ravel(), kind="stable")
    first = np.searchsorted(spot.ravel()[by], spot.ravel()[by])
    ask = by[np.arange(len(by)) - first <= k]
    u, v = closest(at[placed[ask]], ask, k)
    more = np.arange(len(by)) - first > k
    low = components(n, placed[np.concatenate((ask[u], by[more]))], placed[np.concatenate((ask[v], by[first[more]]))])
    return float(np.bincount(low).max() / n)
