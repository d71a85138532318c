"""Barycentric weights of places in the Delaunay triangles of points, without a triangulation of all of them.

The Delaunay triangle of a place is the one that holds it and whose circle holds no point. It is found as a
linear programme is solved: from some triangle that holds the place, the point that lies deepest in the
circle takes a corner's place, until no point is left in the circle. The deepest point is the one nearest
to the circle's centre, so each round asks all points for it by ``neighbours.search``, for all places that
aren't settled yet. Most are after one round, as their near points are tried first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.lineage import cut
from terrane.operators.neighbours import search

#: Near points that are tried first, and points around a circle's centre that are asked for; rounds before giving up.
NEAR, AROUND, ROUNDS = 16, 6, 60


def hull_of(points: np.ndarray) -> np.ndarray:
    """Places in ``points`` (n, 2) of the corners of their convex hull, counter-clockwise, without any on an edge."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    half: list[list[int]] = []
    for way in (order, order[::-1]):
        kept: list[int] = []
        for i in way:
            while len(kept) > 1:
                (ax, ay), (bx, by), (cx, cy) = points[kept[-2]], points[kept[-1]], points[i]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                kept.pop()
            kept.append(i)
        half.append(kept[:-1])
    return np.array(half[0] + half[1], dtype=int)


def convex_hull(points: DataFrame) -> pd.DataFrame:
    """id, x, y of the hull's corners: each batch's own hull, then the hull of these, which is the driver's."""

    def own(frames):
        for frame in frames:
            yield frame.iloc[hull_of(frame[["x", "y"]].to_numpy(float))] if len(frame) > 2 else frame

    found = points.select("id", "x", "y").mapInPandas(own, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select("id", "x", "y").schema)).toPandas()
    return found.iloc[hull_of(found[["x", "y"]].to_numpy(float))] if len(found) > 2 else found


def inward(q: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Places moved a billionth towards the centre and a little aside, so that none lies on an edge."""
    way = centre - q
    return q + 1e-9 * (way + 1e-3 * np.stack([-way[:, 1], way[:, 0]], axis=1))


def fan(q: np.ndarray, hull: np.ndarray) -> np.ndarray:
    """For each place, the i for which it is in the triangle of the hull's corners 0, i, i + 1; 0 if it is outside."""
    out = np.zeros(len(q), int)
    if len(hull) < 3:
        return out
    for lo in range(0, len(q), 1024):
        d = q[lo : lo + 1024] - hull[0]
        arms = hull[1:] - hull[0]
        side = arms[None, :, 0] * d[:, None, 1] - arms[None, :, 1] * d[:, None, 0]
        i = (side > 0).sum(axis=1)
        inside = (i > 0) & (i < len(arms))
        a, b = hull[np.where(inside, i, 1)], hull[np.where(inside, i, 1) + 1]
        p = q[lo : lo + 1024]
        inside &= (b[:, 0] - a[:, 0]) * (p[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[:, 0] - a[:, 0]) > 0
        out[lo : lo + 1024] = np.where(inside, i, 0)
    return out


def settle(q: np.ndarray, at: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triangles (m, 3, 2) that hold q (m, 2), changed until no candidate (m, k, 2; NaN: none) is in their circle.

    Returns triangles, corners' ids, the circles' centres, and whether a triangle changed. Coordinates are taken
    from q: points are lifted to their squared distance, and a circle is the plane through its corners.
    """
    at, ids, more = at - q[:, None], ids.copy(), more - q[:, None]
    lift, changed = (more**2).sum(-1), np.zeros(len(q), bool)
    ones = np.ones((len(q), 3, 1))
    for _ in range(8 * more.shape[1] + 64):
        corners = np.concatenate([ones, at], axis=2)
        plane = np.linalg.solve(corners, (at**2).sum(-1)[..., None])[..., 0]
        depth = plane[:, :1] + (more * plane[:, None, 1:]).sum(-1) - lift
        depth = np.where(np.isnan(depth), -np.inf, depth)
        best = depth.argmax(axis=1)
        i = np.nonzero(depth[np.arange(len(q)), best] > 1e-11 * (at**2).sum((1, 2)))[0]
        if not len(i):
            break
        p = more[i, best[i]]
        sides = np.stack([np.tile([1.0, 0.0, 0.0], (len(i), 1)), np.c_[np.ones(len(i)), p]], axis=2)
        weights = np.linalg.solve(corners[i].transpose(0, 2, 1), sides)
        share, mu = np.maximum(weights[..., 0], 0.0), weights[..., 1]
        leaves = np.where(mu > 1e-13, share / np.where(mu > 1e-13, mu, 1.0), np.inf).argmin(axis=1)
        at[i, leaves], ids[i, leaves], changed[i] = p, more_ids[i, best[i]], True
    return at + q[:, None], ids, plane[:, 1:] / 2 + q, changed


def barycentric(places: DataFrame, points: DataFrame) -> DataFrame:
    """place, id, weight, inside: points and their weights (which add to 1) that give the value at each place.

    places: place, x, y; points: id, x, y. A place in the hull of the points gets the corners of its Delaunay
    triangle, without those of weight 0 (where points lie on one circle, one of the possible triangles); a place
    outside, or of points that are all on one line, gets its nearest point. Of points at one position the smallest
    id counts, of rows of one place any. Rows without coordinates are left out; no points give no rows.
    """
    there = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    axes, kinds = ["x", "y"], {f.name: f.dataType.simpleString() for f in [*places.schema, *points.schema]}
    double = lambda frame, key: frame.select(key, *[F.col(c).cast("double").alias(c) for c in axes]).where(there)
    points = cut(double(points, "id").groupBy(*axes).agg(F.min("id").alias("id")))
    hull = convex_hull(points)
    corners, corner_ids = hull[axes].to_numpy(float), hull["id"].to_numpy()
    centre = corners.mean(axis=0) if len(corners) else np.zeros(2)
    state = f"place {kinds['place']}, x double, y double, ids array<{kinds['id']}>, cx array<double>, cy array<double>, mx double, my double, done boolean, inside boolean"

    def step(frames):
        """Triangles from the candidates in ``found``; without one yet, the hull's. Settled if nothing changed."""
        for frame in frames:
            if not len(frame):
                continue
            q = frame[axes].to_numpy(float)
            moved = inward(q, centre)
            k = max(map(len, frame["found"]))
            more, more_ids = np.full((len(q), k, 2), np.nan), np.zeros((len(q), k), corner_ids.dtype)
            for n, found in enumerate(frame["found"]):
                more[n, : len(found)], more_ids[n, : len(found)] = [(x["x"], x["y"]) for x in found], [x["id"] for x in found]
            first = "ids" not in frame
            if first:
                i = fan(moved, corners)
                same = (more[:, 0] == q).all(axis=1)
                inside = (i > 0) & ~same
                chosen = np.stack([np.zeros_like(i), i, i + 1], axis=1)[inside]
                at, ids = corners[chosen], corner_ids[chosen]
            else:
                inside, same = np.ones(len(q), bool), np.zeros(len(q), bool)
                at, ids = np.stack([np.stack(frame["cx"]), np.stack(frame["cy"])], axis=2), np.stack(frame["ids"])
            out = frame[["place", *axes]].assign(ids=[[x] for x in more_ids[:, 0]], cx=[[x] for x in more[:, 0, 0]], cy=[[x] for x in more[:, 0, 1]], mx=0.0, my=0.0, done=True, inside=same)
            if inside.any():
                at, ids, middle, changed = settle(moved[inside], at, ids, more[inside], more_ids[inside])
                part = frame.loc[inside, ["place", *axes]].assign(ids=list(ids), cx=list(at[..., 0]), cy=list(at[..., 1]), mx=middle[:, 0], my=middle[:, 1], done=~changed & (not first), inside=True)
                out = pd.concat([out[~inside], part])
            yield out

    asked = cut(double(places, "place").dropDuplicates(["place"]))
    near = search(asked, points, ["place", *axes], axes, NEAR, with_place=True)
    now, out = cut(near.mapInPandas(step, state)), None
    for _ in range(ROUNDS):
        part = now.where("done")
        out = part if out is None else out.unionByName(part)
        open_ = now.where("not done")
        if not open_.limit(1).count():
            return out.mapInPandas(weights_of, f"place {kinds['place']}, id {kinds['id']}, weight double, inside boolean")
        middles = search(open_.select("place", F.col("mx").alias("x"), F.col("my").alias("y")), points, ["place"], axes, AROUND, with_place=True)
        now = cut(open_.join(middles, "place").mapInPandas(step, state))
    raise RuntimeError(f"{now.where('not done').count()} places have no triangle after {ROUNDS} rounds")


def weights_of(frames):
    """One row for each corner that counts."""
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            w = np.ones(1)
            if len(row.ids) == 3:
                w = np.linalg.solve(np.stack([np.ones(3), np.asarray(row.cx) - row.x, np.asarray(row.cy) - row.y]), [1.0, 0.0, 0.0])
                w = np.where(w < 1e-12, 0.0, w)
            rows += [(row.place, i, v, row.inside) for i, v in zip(row.ids, w / w.sum(), strict=True) if v > 0]
        yield pd.DataFrame(rows, columns=["place", "id", "weight", "inside"])
