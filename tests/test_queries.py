import math

import numpy as np
import pytest
from terrane.plans import catalogue
from terrane.sources import adapters

from tests.differential import connect, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert spark_rows(catalogue.QUERIES[name](spark, FOLDER)) == duck_rows(con, catalogue.ORACLES[name])


def rows_of(spark, name):
    return catalogue.QUERIES[name](spark, FOLDER).collect()


def wave(spark):
    """The grid that masks work on, as an array."""
    from terrane.plans.spatial_queries import _wave

    g = np.full((76, 101), np.nan)
    for x in _wave(spark, FOLDER).collect():
        g[x.row, x.col] = x.v
    return g


def pixels(rows):
    return {(x.row, x.col) for x in rows}


def masks_a_bright_part(spark, rows):
    g, mask = wave(spark), pixels(rows)
    inside = np.array([g[p] for p in mask])
    outside = np.array([g[r, c] for r in range(76) for c in range(101) if (r, c) not in mask])
    assert len(mask) == len(rows) and inside.mean() > outside.mean() + outside.std()


def adaptive(spark, rows):
    g = wave(spark)
    assert len(rows) == 1 and 80 <= rows[0].area <= 2200 and 1 <= rows[0].n <= 2
    assert rows[0].area <= (g >= np.quantile(g, rows[0].q)).sum()


def net(spark, rows):
    assert len(rows) == 53 * adapters.GENES and all(x.weight >= 0 and x.gap < 1e-9 for x in rows)


def clusters(spark, rows):
    points = {x.obs_id: x for x in adapters.observations(spark, FOLDER).collect()}
    xyz = np.array([[points[x.obs_id][c] for c in "xyz"] for x in rows])
    xyz = (xyz - xyz.mean(0)) / xyz.std(0)
    own = np.array([x.domain for x in rows])
    centres = np.stack([xyz[own == k].mean(0) for k in np.unique(own)])
    nearest = ((xyz[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
    assert len(centres) == 6 and (np.unique(own)[nearest] == own).mean() > 0.98


def mixed(spark, rows):
    g = wave(spark)
    by = sorted((g[x.row, x.col], x.posterior) for x in rows)
    assert all(0.5 <= x.posterior <= 1 for x in rows) and by[0][1] < by[-1][1]


def gate(spark, rows):
    for x in rows:
        gain = (x.global_mse - x.spatial_mse) / x.global_mse
        assert abs(gain - x.relative_gain) < 1e-9 and x.improved == (gain > 0)
    for gene in range(adapters.GENES):
        gains = [x.relative_gain for x in rows if x.gene == gene]
        assert {x.enabled for x in rows if x.gene == gene} == {sum(g > 0 for g in gains) >= 3 and np.mean(gains) >= 0.002 and min(gains) >= -0.01}


def tails(spark, rows):
    df = adapters.observations(spark, FOLDER).count() - 2
    half = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    for x in rows[::40]:
        if abs(x.t_stat) < 6:
            at = np.linspace(x.t_stat, x.t_stat + 40, 400_001)
            density = np.exp(half - (df + 1) / 2 * np.log1p(at * at / df))
            assert abs(np.trapezoid(density, at) - x.p) < 1e-6
        assert x.significant == (x.p < 0.01)


def components(spark, rows):
    z = np.array([x.pc for x in sorted(rows, key=lambda x: x.vec_id)])
    cov = np.cov(z.T)
    assert np.all(np.diff(np.diag(cov)) <= 1e-9) and np.abs(cov - np.diag(np.diag(cov))).max() < 1e-6 * cov[0, 0]


def walker(spark, rows):
    g, top = wave(spark), pixels(rows)
    assert rows and all(0.7 <= x.p <= 1 for x in rows) and min(g[p] for p in top) >= np.quantile(g, 0.82) - 1e-6
    assert sum(x.p == 1 for x in rows) > 0.2 * len(rows)


def resampled(spark, rows):
    z = [x.z for x in adapters.observations(spark, FOLDER).collect()]
    assert len(rows) == 19 * 25 and all(min(z) - 1e-6 <= x.v <= max(z) + 1e-6 for x in rows)


def encoded(spark, rows):
    assert len({(x.gene, x.row, x.col) for x in rows}) == len(rows) and all(math.isfinite(x.prediction) and math.isfinite(x.global_prediction) for x in rows)
    assert np.std([x.prediction for x in rows]) > 0


def recovered(spark, rows):
    n = {(x.truth, x.predicted_class): x.n for x in rows}
    assert n["core_concordant", "core_concordant"] == 10 and n.get(("unsupported", "unsupported"), 0) >= 4
    assert sum(v for (t, p), v in n.items() if t.startswith("regional") and p == "regional_candidate") >= 4


def scenarios(spark, rows):
    assert len({x.scenario for x in rows}) == 6 and all(x.activity >= 0 for x in rows)


def some(spark, rows):
    assert rows


def sketched(spark, rows):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").select("event_type", "user_id", "value").collect()
    assert {x.event_type for x in rows} == {e.event_type for e in events}
    for x in rows:
        own = [e for e in events if e.event_type == x.event_type]
        users, values = [e.user_id for e in own], sorted(e.value for e in own if e.value is not None)
        assert x.n == len(own) and abs(x.distinct - len(set(users))) <= 0.03 * len(set(users)) + 1
        assert all(abs(np.searchsorted(values, v, side="right") / len(values) - q) < 0.03 or values.count(v) > 0.03 * len(values) for q, v in ((0.5, x.q50), (0.9, x.q90), (0.99, x.q99)))
        assert all(f["count"] == users.count(f["item"]) for f in x.frequent) and x.frequent[0]["count"] == max(users.count(u) for u in set(users))


CHECKS = {
    "active_contour_mask": masks_a_bright_part, "diffusion_cluster_mask": masks_a_bright_part, "adaptive_quantile_mask": adaptive, "elastic_net": net, "kmeans_domains": clusters, "mixture_mask": mixed,
    "nested_feature_gate": gate, "one_tailed_p_values": tails, "principal_components": components, "random_walker_mask": walker, "resampled": resampled, "merged_sketches": sketched, "set_encoder": encoded, "simulated_recovery": recovered,
    "simulated_scenarios": scenarios, "resumable_chunks": some, "star_and_manifest": some,
}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_numbers_without_sql(spark, name):
    CHECKS[name](spark, rows_of(spark, name))


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 8 and {r.screen_rank for r in rows} == set(range(1, 9))
