"""Exact Hamming range search by vantage-point trees, over shards of fingerprints.

The 64 bits are cut into BLOCKS disjoint blocks. Two fingerprints within LIMIT bits differ in at most
LIMIT // BLOCKS bits of some block, and Hamming distance on a block obeys the triangle inequality. So
for each block there is a tree whose nodes hold a vantage point v and a radius m: points with
d(x, v) <= m go inside, the others outside. A pair within r can lie on two sides only if the inner
point has d > m - r, or the outer d <= m + r: those points also visit the other side.

A small tree, fitted to a bounded sample, deals fingerprints out to shards, home and visiting. Inside a
shard the same rule goes on, vectorised, until sets are small enough to compare on all 64 bits.
Branches whose points are joined already are pruned: they can't join anything more.
"""

from __future__ import annotations

import numpy as np

LIMIT, BLOCKS = 4, 3
LEAF = 768
WIDTHS = (22, 21, 21)
MASKS = tuple(np.uint64(((1 << w) - 1) << sum(WIDTHS[:i])) for i, w in enumerate(WIDTHS))
REACH = LIMIT // BLOCKS
#: Vantage points tried at a node of the sharding tree.
TRIES = 8


def distance(points: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    """Bits of the block in which points differ from the vantage point."""
    return np.bitwise_count((points ^ vantage) & mask)


def build(sample: np.ndarray, block: int, leaves: int, rng: np.random.Generator, first: int = 0) -> tuple[list, int]:
    """Tree of about ``leaves`` shards, numbered from ``first``: a shard's number, or (vantage, radius, inner, outer)."""
    if leaves <= 1 or len(sample) < 4:
        return first, first + 1
    best = None
    for vantage in rng.choice(sample, min(TRIES, len(sample)), replace=False):
        d = distance(sample, vantage, MASKS[block])
        radius = int(np.median(d))
        radius -= radius == d.max()
        inside = int((d <= radius).sum())
        if 0 < inside < len(sample):
            # The larger side with its visitors; ties by the sum of both.
            cost = max(inside, len(sample) - inside + int((d == radius).sum()))
            if best is None or cost < best[0]:
                best = (cost, vantage, radius, d)
    if best is None:
        return first, first + 1
    _, vantage, radius, d = best
    share = (d <= radius).mean()
    inner_leaves = min(leaves - 1, max(1, round(leaves * share)))
    inner, after = build(sample[d <= radius], block, inner_leaves, rng, first)
    outer, after = build(sample[d > radius], block, leaves - inner_leaves, rng, after)
    return (vantage, radius, inner, outer), after


def split(d_home: np.ndarray, d_visit: np.ndarray, radius: int):
    """Masks: home inside, home that also visits outside, visitors inside, visitors outside.

    One direction is enough for home points: a pair across the boundary meets on the outer side.
    """
    inside = d_home <= radius
    return inside, inside & (d_home > radius - REACH), d_visit <= radius + REACH, d_visit > radius - REACH


def route(tree, block: int, points: np.ndarray):
    """Yields (shard, home?, indexes of points), for all shards that points belong to or must visit."""
    stack = [(tree, np.arange(len(points)), np.arange(0))]
    while stack:
        node, home, visit = stack.pop()
        if not isinstance(node, tuple):
            yield node, True, home
            yield node, False, visit
            continue
        vantage, radius, inner, outer = node
        d, e = distance(points[home], vantage, MASKS[block]), distance(points[visit], vantage, MASKS[block])
        inside, crossing, visit_in, visit_out = split(d, e, radius)
        stack.append((inner, home[inside], visit[visit_in]))
        stack.append((outer, home[~inside], np.concatenate([home[crossing], visit[visit_out]])))


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j, pair by pair; labels stay the least index of each set."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _compare(points: np.ndarray, label: np.ndarray, home: np.ndarray, everyone: np.ndarray) -> None:
    """Joins all pairs of home and everyone within LIMIT bits."""
    step = max(1, (1 << 20) // max(1, len(everyone)))
    theirs = points[everyone]
    for at in range(0, len(home), step):
        part = home[at : at + step]
        near = np.bitwise_count(points[part][:, None] ^ theirs[None, :]) <= LIMIT
        near[label[part][:, None] == label[everyone][None, :]] = False
        i, j = np.nonzero(near)
        if len(i):
            _merge(label, part[i], everyone[j])


def join_shard(points: np.ndarray, n_home: int, block: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (member, least member) of the sets that home points (the first ``n_home``) link; points are distinct."""
    label = np.arange(len(points))
    rng = np.random.default_rng(seed)
    stack = [(np.arange(n_home), np.arange(n_home, len(points)))]
    while stack:
        home, visit = stack.pop()
        everyone = np.concatenate([home, visit])
        if len(home) == 0 or len(everyone) < 2:
            continue
        known = label[everyone]
        if (known == known[0]).all():
            continue
        if len(everyone) <= LEAF:
            _compare(points, label, home, everyone)
            continue
        for _ in range(3):
            at = home[rng.integers(len(home))]
            star = np.bitwise_count(points[everyone] ^ points[at]) <= LIMIT
            near = everyone[star]
            _merge(label, near, np.full(len(near), at))
            d = distance(points[home], points[at], MASKS[block])
            radius = int(np.median(d))
            radius -= radius == d.max()
            if radius < 0:
                continue
            e = distance(points[visit], points[at], MASKS[block])
            inside, crossing, visit_in, visit_out = split(d, e, radius)
            sizes = inside.sum() + visit_in.sum(), (~inside).sum() + crossing.sum() + visit_out.sum()
            if max(sizes) < 0.9 * len(everyone):
                stack.append((home[inside], visit[visit_in]))
                stack.append((home[~inside], np.concatenate([home[crossing], visit[visit_out]])))
                break
        else:
            _compare(points, label, home, everyone)
    members = np.flatnonzero(label != np.arange(len(label)))
    return members, label[members]
