import numpy as np
from terrane.operators import periodic as P

R = np.random.default_rng(4)


def test_null_of_clustered_points_agrees_with_numpy(spark):
    """Half of the points lie in one place, so that most shifted points take from a few."""
    n, genes, drivers, perms = 160, 2, 3, 12
    at = np.concatenate([np.tile([[0.5, 0.5, 0.5]], (n // 4, 1)), R.normal(0.5, 1e-3, (n // 4, 3)), R.uniform(0, 1, (n // 2, 3))])
    domain = R.integers(0, 3, n)
    y, x = R.gamma(1, 1, (genes, n)), R.gamma(1, 1, (genes, n, drivers))
    y[1, domain == 1] = 2.5
    x[0, :, 2] = 7.0
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "obs_id long, x double, y double, z double").repartition(3)
    shifts = P.random_shifts(perms, 3, 11)
    assert (shifts == P.random_shifts(perms, 3, 11)).all() and (shifts != P.random_shifts(perms, 3, 12)).any() and shifts.min() >= 0.1 and shifts.max() <= 0.9
    sources = P.shifted_sources(P.unit_box(points, ["x", "y", "z"]), "obs_id", ["x", "y", "z"], shifts).cache()
    unit = np.minimum((at - at.min(0)) / np.ptp(at, axis=0), 0.9999999999999999)
    src = np.zeros((perms, n), int)
    for k in range(perms):
        gap = np.abs(((unit + shifts[k]) % 1)[:, None] - unit[None])
        src[k] = np.round((np.minimum(gap, 1 - gap) ** 2).sum(-1), 9).argmin(1)
    assert {(r.perm, r.obs): r.src for r in sources.collect()} == {(k, i): src[k, i] for k in range(perms) for i in range(n)}
    assert max(np.bincount(s, minlength=n).max() for s in src) > n // 5
    rows = [(i, int(domain[i]), g, float(y[g, i]), x[g, i].tolist()) for i in range(n) for g in range(genes)]
    signals = spark.createDataFrame(rows, "obs long, domain int, gene int, y double, x array<double>").repartition(4)
    found = {(r.gene, r.enh, r.perm): r.null_max for r in P.shifted_null(signals, sources, perms).collect()}
    for g in range(genes):
        for e in range(drivers):
            for k in range(perms):
                best = -np.inf
                for d in range(3):
                    a, b = x[g, src[k], e][domain == d], y[g][domain == d]
                    spread = np.sqrt(((a - a.mean()) ** 2).sum() * ((b - b.mean()) ** 2).sum())
                    best = max(best, ((a - a.mean()) * (b - b.mean())).sum() / spread if spread > 1e-9 else 0.0)
                assert abs(found[g, e, k] - best) < 2e-6, (g, e, k)
    assert len(found) == genes * drivers * perms
