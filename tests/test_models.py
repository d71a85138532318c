import numpy as np
from terrane.operators import linear as L

R = np.random.default_rng(2)


def rows(spark, n=240, k=5):
    x, domain, fold, gene = R.gamma(1, 1, (n, k)), R.integers(0, 3, n), R.integers(0, 4, n), R.integers(0, 2, n)
    y = x @ np.arange(k) * 0.1 + x[:, 0] * (domain == 1) + R.normal(0, 0.1, n)
    listed = [(int(g), int(f), int(d), float(v), row.tolist()) for g, f, d, v, row in zip(gene, fold, domain, y, x)]
    return spark.createDataFrame(listed, "gene int, fold int, domain int, y double, x array<double>").repartition(5), x, y, gene, fold, domain


def direct(x, y):
    z = np.column_stack([np.ones(len(x)), x, y])
    return z.T @ z


def test_grams_by_group(spark):
    frame, x, y, gene, fold, domain = rows(spark)
    found = {(r.gene, r.fold): np.array(r.gram).reshape(7, 7) for r in L.gram_rows(frame, ["gene", "fold"]).collect()}
    assert len(found) == 8
    for (g, f), m in found.items():
        own = (gene == g) & (fold == f)
        assert np.allclose(m, direct(x[own], y[own]))


def test_products_with_domains(spark):
    """The matrix put together from the domains' equals that of the wide features themselves."""
    _, x, y, _, _, domain = rows(spark)
    wide = np.concatenate([x, *[x * (domain == d)[:, None] for d in range(3)]], axis=1)
    assert np.allclose(L.by_domain([direct(x[domain == d], y[domain == d]) for d in range(3)]), direct(wide, y))


def test_models_are_solved_in_tasks(spark):
    frame, x, y, gene, _, _ = rows(spark)

    def model(part):
        g = part["gram"].iloc[0]
        w, b = L.elastic_net(g)
        return [(int(part["gene"].iloc[0]), float(b), w.tolist(), L.optimality_gap(g, w))]

    for r in L.solve_groups(L.gram_rows(frame, ["gene"]), "gene", model, "gene int, b double, w array<double>, gap double").collect():
        w, b = L.elastic_net(direct(x[gene == r.gene], y[gene == r.gene]))
        assert np.allclose(r.w, w) and np.isclose(r.b, b) and r.gap < 1e-9


def test_nothing_but_the_plan_is_the_drivers(spark):
    frame, *_ = rows(spark)
    assert not L.gram_rows(frame.limit(0), ["gene"]).collect()
