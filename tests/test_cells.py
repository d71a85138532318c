import numpy as np
import pytest
from terrane.operators import cells as C
from terrane.operators import neighbours as N

R = np.random.default_rng(3)


def clouds():
    """Positions that grids and medians find hard: clusters, outliers, equal points, equal coordinates."""
    tight = R.normal(0.2, 1e-4, (300, 3))
    wide = R.uniform(0, 1, (200, 3))
    far = np.array([[40.0, -3.0, 0.5], [-900.0, 0.0, 0.0]])
    same = np.tile([[0.7, 0.7, 0.7]], (150, 1))
    flat = np.c_[np.zeros(200), R.integers(0, 9, 200) / 8, R.uniform(0, 1, 200)]
    return np.concatenate([tight, wide, far, same, flat])


def brute(q, at, ids, k, periodic=False):
    gap = np.abs(q[:, None] - at[None])
    gap = np.minimum(gap, 1 - gap) if periodic else gap
    d2 = np.round((gap**2).sum(-1), 9)
    return [sorted(zip(row.tolist(), ids))[:k] for row in d2]


def frame(spark, at, names="xyz"):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "obs_id long, " + ", ".join(f"{c} double" for c in names)).repartition(3)


@pytest.mark.parametrize("per_cell", [4, 40, 10_000])
def test_search_is_exact(spark, per_cell):
    at = clouds()
    points = frame(spark, at).withColumnRenamed("obs_id", "id")
    q = np.concatenate([at[::9], R.uniform(-2, 2, (60, 3)), [[1e4, 0, 0]]])
    asked = frame(spark, q).withColumnRenamed("obs_id", "q")
    found = {r.q: [(x.d2, x.id) for x in r.found] for r in N.search(asked, points, ["q"], ["x", "y", "z"], 5, per_cell=per_cell).collect()}
    assert found == dict(enumerate(brute(q, at, range(len(at)), 5)))


def test_periodic_search_is_exact(spark):
    at = np.concatenate([R.normal(0.03, 0.01, (300, 3)) % 1, R.uniform(0, 1, (60, 3)), np.tile([[0.999, 0.5, 0.001]], (50, 1))])
    q = np.concatenate([R.uniform(0, 1, (100, 3)), [[0.0, 0.0, 0.0], [0.9999999, 0.0, 0.5], [0.001, 0.5, 0.999]]])
    points, asked = frame(spark, at).withColumnRenamed("obs_id", "id"), frame(spark, q)
    found = {r.obs_id: [(x.d2, x.id) for x in r.found] for r in N.search(asked, points, ["obs_id"], ["x", "y", "z"], 1, periodic=True, per_cell=8).collect()}
    assert found == dict(enumerate(brute(q, at, range(len(at)), 1, True)))


def test_nearest_points(spark):
    """Each of 150 equal points has others of that position only; missing coordinates are left out."""
    at = clouds()
    points = frame(spark, at).unionByName(spark.createDataFrame([(5000, None, 1.0, 1.0), (5001, float("nan"), 1.0, 1.0)], "obs_id long, x double, y double, z double"))
    found = {}
    for r in N.nearest_points(points, 4, ["x", "y", "z"]).collect():
        found.setdefault(r.src, []).append((r["rank"], r.d2, r.dst))
    wanted = brute(at, at, range(len(at)), 160)
    assert found.keys() == set(range(len(at)))
    for i, near in enumerate(wanted):
        others = [x for x in near if x[1] != i][:4]
        assert [x[1:] for x in sorted(found[i])] == others and [x[0] for x in sorted(found[i])] == [1, 2, 3, 4]


def test_few_points_and_answers(spark):
    three = frame(spark, [[0, 0, 0], [1, 0, 0], [5, 0, 0]])
    rows = {(r.src, r["rank"]): r.dst for r in N.nearest_points(three, 5, ["x", "y", "z"]).collect()}
    assert rows == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 2, (2, 1): 1, (2, 2): 0}
    rows = {(r.src, r["rank"]): r.dst for r in N.nearest_points(three, 5, ["x", "y", "z"], answers="id > 1").collect()}
    assert rows == {(0, 1): 2, (1, 1): 2}
    assert N.nearest_points(three.limit(0), 2, ["x", "y", "z"]).count() == 0


def test_cells_follow_the_points():
    """Cells stay near their size on clusters, and few of them are met by a small ball."""
    at = np.unique(np.concatenate([R.normal(0, 1e-3, (20_000, 3)), R.uniform(-5, 5, (20_000, 3)), np.c_[np.zeros(20_000), R.uniform(-5, 5, (20_000, 2))]]), axis=0)
    splits = C.fit(at[::7], len(at), 200)
    leaf = splits.leaf(at)
    kinds, count = np.unique(leaf, return_counts=True)
    lo, hi = (np.stack([f(at[leaf == k], axis=0) for k in kinds]) for f in (np.min, np.max))
    cells = C.gather(splits, kinds, count, lo, hi, 7)
    sizes = np.bincount(cells.home(at))
    assert sizes.min() >= 7 and sizes.max() < 1500 and 100 < cells.n < 600
    q = at[::500]
    who, there = cells.near(q, np.full(len(q), 1e-8))
    assert set(zip(range(len(q)), cells.home(q))) <= set(zip(who, there)) and len(who) < 2 * len(q)
    who, there = cells.near(q, np.full(len(q), np.inf))
    assert {(i, c) for i in range(len(q)) for c in range(cells.n)} <= set(zip(who, there))
