import numpy as np
import pytest
from terrane.operators import clusters as C

R = np.random.default_rng(9)


def lloyd(points, centres):
    for _ in range(200):
        own, _ = C.assigned(points, centres)
        moved = np.stack([points[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        if np.abs(moved - centres).max() < 1e-12:
            break
        centres = moved
    return C.assigned(points, centres)[1].sum()


def test_cost_is_that_of_the_best_start(spark):
    """Nested clusters, where single starts often fail; half of the points are equal."""
    points = np.concatenate([R.normal(m, 0.3, (25, 2)) for m in ((0, 0), (1.5, 0), (0, 1.5), (20, 20), (21.5, 20))] + [np.tile([[40.0, 0.0]], (125, 1))])
    frame = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double").repartition(4)
    centres, costs = C.kmeans(frame, ["x", "y"], 6, n_starts=8)
    ordered = points[np.lexsort(points.T)]
    singles = [lloyd(points, s) for s in C.starts(ordered, 6, 8, 7)]
    assert np.allclose(costs, singles) and max(singles) > 1.2 * min(singles)
    assert np.isclose(C.assigned(points, centres)[1].sum(), min(singles)) and (np.diff(centres[:, 0]) >= 0).all()
    labels = {r.label for r in C.labelled(frame, ["x", "y"], centres, "label").collect()}
    assert labels == set(range(6))


def test_fewer_points_than_clusters(spark):
    frame = spark.createDataFrame([(1.0,), (5.0,)], "x double")
    centres, costs = C.kmeans(frame, ["x"], 3, n_starts=2)
    assert costs.min() == 0 and set(centres.ravel()) == {1.0, 5.0}
    with pytest.raises(ValueError, match="no rows"):
        C.kmeans(frame.limit(0), ["x"], 3)


def test_components_against_an_exact_solve(spark):
    n, p, k = 300, 40, 5
    x = R.normal(size=(n, 6)) @ (R.normal(size=(6, p)) * np.array([9, 7, 5, 4, 3, 2])[:, None]) + R.normal(size=(n, p)) + 100
    x[:, 7] = 4.0
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>").repartition(3)
    mean, deviation, found, variances = C.components(frame, "v", k)
    z = (x - x.mean(0)) * np.where(x.std(0, ddof=1) > 1e-12, 1 / np.maximum(x.std(0, ddof=1), 1e-12), 0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    assert np.allclose(variances, values[::-1][:k], rtol=1e-4)
    assert (np.linalg.svd(found @ vectors[:, ::-1][:, :k])[1] > 0.999).all() and np.allclose(found @ found.T, np.eye(k), atol=1e-9)
    rows = {r.id: r.pc for r in C.projected(frame, "v", mean, deviation, found, "pc").collect()}
    assert np.allclose([rows[i] for i in range(n)], z @ found.T)
