from itertools import combinations

import numpy as np
import pytest
from terrane.operators import triangles as T

R = np.random.default_rng(6)


def weights(spark, q, at):
    places = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(q)], "place long, x double, y double").repartition(2)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, x double, y double").repartition(3)
    out = {}
    for r in T.barycentric(places, points).collect():
        assert r.weight > 0
        out.setdefault(r.place, {})[r.id] = (r.weight, r.inside)
    return out


def circle(a, b, c):
    m = np.linalg.solve(2 * np.array([b - a, c - a]), [b @ b - a @ a, c @ c - a @ a])
    return m, np.sum((a - m) ** 2)


def area(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def holds(found, q, at):
    """The weights add to 1, give the place itself (so any linear function), and the triangle's circle is empty."""
    ids = list(found)
    w = np.array([found[i][0] for i in ids])
    assert abs(w.sum() - 1) < 1e-9 and np.abs(w @ at[ids] - q).max() < 1e-8
    if len(ids) == 3:
        m, r2 = circle(*at[ids])
        assert ((at - m) ** 2).sum(1).min() > r2 * (1 - 1e-7)


def clouds():
    ring = np.c_[np.cos(t := R.uniform(0, 6.28, 300)), np.sin(t)] * R.uniform(3, 4, (300, 1))
    dense = R.normal([0.5, 0.2], 0.01, (200, 2))
    grid = np.stack(np.meshgrid(np.arange(8.0), np.arange(6.0)), axis=-1).reshape(-1, 2)
    return {"uniform": R.uniform(0, 10, (250, 2)), "a hole and a cluster": np.concatenate([ring, dense]), "grid": grid, "equal points": np.concatenate([np.tile(R.uniform(0, 10, (1, 2)), (60, 1)), R.uniform(0, 10, (40, 2))])}


@pytest.mark.parametrize("name", clouds())
def test_delaunay_triangles(spark, name):
    at = clouds()[name]
    lo, hi = at.min(0), at.max(0)
    q = np.concatenate([R.uniform(lo, hi, (60, 2)), at[:5], (at[:1] + at[1:2]) / 2, [[hi[0] + 5, lo[1]]]])
    found = weights(spark, q, at)
    hull = at[T.hull_of(at)]
    assert found.keys() == set(range(len(q)))
    n_inside = 0
    for i, p in enumerate(q):
        inside = {x[1] for x in found[i].values()}
        assert len(inside) == 1
        if inside.pop():
            holds(found[i], p, at)
            n_inside += 1
        else:
            assert min(area(a, b, p) for a, b in zip(hull, np.roll(hull, -1, axis=0))) < 1e-6
            d2 = ((at - p) ** 2).sum(1)
            assert len(found[i]) == 1 and abs(d2[next(iter(found[i]))] - d2.min()) < 2e-9
    assert n_inside > 30


def test_same_triangles_as_all_triples(spark):
    at, q = R.uniform(0, 1, (25, 2)), R.uniform(0, 1, (40, 2))
    found = weights(spark, q, at)
    empty = [ids for ids in combinations(range(len(at)), 3) if np.all(((np.delete(at, ids, 0) - (mr := circle(*at[list(ids)]))[0]) ** 2).sum(1) > mr[1])]
    for i, p in enumerate(q):
        own = [ids for ids in empty if len({np.sign(area(*x)) for x in ((at[ids[0]], at[ids[1]], p), (at[ids[1]], at[ids[2]], p), (at[ids[2]], at[ids[0]], p))}) == 1]
        assert [set(x) for x in own] == ([set(found[i])] if len(found[i]) == 3 else [])


def test_points_on_a_line_few_points_and_none(spark):
    line = np.c_[np.arange(5.0), np.arange(5.0)]
    assert weights(spark, [[1.2, 1.2], [9.0, 0.0]], line) == {0: {1: (1.0, False)}, 1: {4: (1.0, False)}}
    assert weights(spark, [[0.0, 0.0]], line[:1]) == {0: {0: (1.0, True)}}
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "place long, x double, y double")
    assert T.barycentric(places, spark.createDataFrame([], "id long, x double, y double")).count() == 0
