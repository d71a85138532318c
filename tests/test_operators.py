import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from terrane.functions import student
from terrane.functions.numeric import average_rank, correlation, entropy, moments, with_q_values
from terrane.operators import evidence as E
from terrane.operators import linear as L
from terrane.operators import masks, raster, setmodel
from terrane.operators import neighbours as N
from terrane.operators import relational as R
from terrane.operators import simulate as M
from terrane.operators.components import connected_components
from terrane.operators.order import centred_ranks, sliced
from terrane.sources import tables as T


def edges_frame(spark, pairs):
    return spark.createDataFrame(pairs, "u long, v long")


@pytest.mark.parametrize("seed", range(4))
def test_components_match_union_find(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1090)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(edges_frame(spark, pairs)).collect()}
    assert got == {x: find(x) for x in linked}


def test_components_of_nothing(spark):
    assert connected_components(edges_frame(spark, [])).count() == 0
    assert connected_components(edges_frame(spark, [(1, 1), (None, 2)])).count() == 0


def test_correlation_guards(spark):
    rows = [("few", float(i), float(i)) for i in range(2)] + [("flat", 1.0, float(i)) for i in range(9)] + [("seven", float(i), float(i)) for i in range(7)] + [("line", float(i), -2.0 * i) for i in range(9)] + [("line", None, 1.0)]
    g = spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(*moments("x", "y"))
    got = {r.k: (r.a, r.b, r.c) for r in g.select("k", correlation("zero").alias("a"), correlation("zero_std").alias("b"), correlation("null").alias("c")).collect()}
    assert got["few"] == (1.0, 0.0, None) and got["flat"] == (0.0, 0.0, None)
    assert got["seven"][1] == 0.0 and abs(got["seven"][2] - 1) < 1e-12 and all(abs(v + 1) < 1e-12 for v in got["line"])


def test_ranks_q_values_and_entropy(spark):
    p = [0.01, 0.04, 0.03, 0.03, 0.9]
    f = spark.createDataFrame([(1, i, x) for i, x in enumerate(p)], "g int, i int, p double")
    q = {r.i: r.q for r in with_q_values(f, "p", ["g"], "q").collect()}
    ordered = sorted(p)
    want = {i: min(1, min(ordered[k] * 5 / (k + 1) for k in range(5) if ordered[k] >= x)) for i, x in enumerate(p)}
    assert all(abs(q[i] - want[i]) < 1e-12 for i in q)
    assert [q[i] for i in np.argsort(p, kind="stable")] == sorted(q.values())
    ranks = {r.i: r.k for r in f.select("i", average_rank("p", ["g"]).alias("k")).collect()}
    assert ranks == {0: 1.0, 2: 2.5, 3: 2.5, 1: 4.0, 4: 5.0}
    e = spark.createDataFrame([("a", 4), ("b", 1), ("b", 1), ("c", 1), ("c", 3)], "g string, n long").groupBy("g").agg(entropy("n").alias("e"))
    got = {r.g: r.e for r in e.collect()}
    assert got["a"] == 0 and abs(got["b"] - 1) < 1e-12 and abs(got["c"] + (0.25 * math.log(0.25) + 0.75 * math.log(0.75)) / math.log(2)) < 1e-12


def test_student_tail():
    # One-sided critical points of Student's t.
    for df, t, p in ((1, 6.313752, 0.05), (5, 2.015048, 0.05), (10, 2.763769, 0.01), (30, 2.457262, 0.01), (100, 1.660234, 0.05), (498, 2.333844, 0.01)):
        assert abs(student.survival(np.array([t]), np.array([df]))[0] - p) < 2e-5
    assert abs(student.survival(np.array([0.0]), np.array([7]))[0] - 0.5) < 1e-12
    assert abs(student.survival(np.array([-2.0]), np.array([9]))[0] + student.survival(np.array([2.0]), np.array([9]))[0] - 1) < 1e-12
    assert np.isnan(student.survival(np.array([1.0]), np.array([0]))[0])


@pytest.mark.parametrize("axes, grouped", [(["x", "y"], False), (["x", "y", "z"], True)])
def test_nearest_matches_brute_force(spark, axes, grouped):
    r = random.Random(len(axes))
    # A dense cluster, a lattice with ties and a few far points: rings must widen.
    pts = [(i, r.gauss(0, 0.01), r.gauss(0, 0.01), r.random()) for i in range(120)] + [(200 + i, float(i % 7), float(i // 7), 0.0) for i in range(49)] + [(900 + i, 50.0 * i, 9.0, -3.0) for i in range(4)]
    rows = [(p[0] % 2 if grouped else 0, *p) for p in pts]
    got = {}
    f = spark.createDataFrame(rows, "g int, obs_id long, x double, y double, z double")
    for e in N.nearest(f, 5, axes, by=["g"] if grouped else None).collect():
        got.setdefault(e.src, []).append((e["rank"], e.dst))
    index = {"x": 2, "y": 3, "z": 4}
    for a in rows:
        d = sorted((round(sum((a[index[c]] - b[index[c]]) ** 2 for c in axes), 9), b[1]) for b in rows if b[0] == a[0] and b[1] != a[1])
        assert [n for _, n in sorted(got[a[1]])] == [n for _, n in d[:5]]


def test_range_joins(spark):
    r = random.Random(3)
    a = [(i, r.randrange(3), r.randrange(-500, 500)) for i in range(80)]
    b = [(i, r.randrange(4), r.randrange(-500, 500)) for i in range(80)]
    left, right = spark.createDataFrame(a, "i int, c int, at long"), spark.createDataFrame(b, "j int, c int, there long")
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and abs(x[2] - y[2]) <= 25}
    assert {(e.i, e.j) for e in N.range_join(left, right, ["c"], "at", "there", 25).collect()} == want
    assert {e.i for e in N.range_anti_join(left, right, ["c"], "at", "there", 25).collect()} == {x[0] for x in a} - {i for i, _ in want}


def test_scan_contracts(spark):
    f = spark.createDataFrame([(1, 2, 0.5)], "obs_id long, var_id int, value double")
    with pytest.raises(KeyError):
        R.read_features(f, [2, 3])
    with pytest.raises(ValueError):
        R.require_columns(f, ["target"])
    links = spark.createDataFrame([("a", "r1"), ("a", "r2"), ("b", "r1"), ("a", "r1")], "target string, region string")
    known = links.select("target").distinct()
    got = R.read_links(links, known, links.select("region").distinct(), top_k=1).collect()
    assert sorted((x.target, x.region, x.importance_x_abs_rho) for x in got) == [("a", "r1", 0.0), ("b", "r1", 0.0)]
    with pytest.raises(Exception, match="not an interval"):
        spark.createDataFrame([("oops",)], "t string").select(R.parse_interval(F.col("t"), strict=True)).collect()


def test_top2_kept_components_and_majority(spark):
    hot = [(0, c) for c in range(5)] + [(3, c) for c in range(3)] + [(6, 6), (7, 7)] + [(9, 0)]
    f = spark.createDataFrame(hot, "row int, col int")
    comps = raster.components(f, 10, 10)
    stats = raster.component_stats(comps).first()
    assert (stats.n_components, stats.largest, stats.hot) == (4, 5, 11)
    kept = raster.keep_largest(comps, least=3, most=2).collect()
    assert sorted((k.row, k.col) for k in kept) == sorted(hot[:8])
    grid = np.zeros((6, 6), int)
    grid[1:4, 1:4] = 1
    grid[5, 5] = 1
    rows = [(i, j, int(grid[i, j])) for i in range(6) for j in range(6)]
    got = np.zeros((6, 6), int)
    for x in raster.majority(spark.createDataFrame(rows, "row int, col int, v int"), rounds=1).collect():
        got[x.row, x.col] = x.v
    p = np.pad(grid, 1, mode="edge")
    assert np.array_equal(got, (sum(p[i : i + 6, j : j + 6] for i in range(3) for j in range(3)) >= 5).astype(int))


def test_two_state_matches_a_loop(spark):
    r = np.random.default_rng(2)
    v = np.concatenate([r.normal(0.2, 0.05, 60), r.normal(0.8, 0.1, 30)])
    c0, c1 = np.quantile(v, [0.25, 0.75])
    for _ in range(25):
        z = np.abs(v - c1) < np.abs(v - c0)
        c0, c1 = v[~z].mean() if (~z).any() else c0, v[z].mean() if z.any() else c1
    f = spark.createDataFrame([(1, float(x)) for x in v] + [(2, 0.5)] * 5, "g int, v double")
    got = {x.g: (x.low, x.high) for x in raster.two_state(f, ["g"]).collect()}
    assert abs(got[1][0] - min(c0, c1)) < 1e-9 and abs(got[1][1] - max(c0, c1)) < 1e-9 and got[2] == (0.5, 0.5)


def test_mixture_finds_two_groups(spark):
    r = np.random.default_rng(4)
    v = np.round(np.concatenate([r.normal(0, 1, 4000), r.normal(6, 0.5, 1000)]), 2)
    m = masks.mixture(spark.createDataFrame([(float(x),) for x in v], "v double").groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    assert abs(m["mu_low"]) < 0.1 and abs(m["mu_high"] - 6) < 0.1 and abs(m["w_high"] - 0.2) < 0.02
    # The same from aggregates, a pass a round.
    passes = masks.mixture(spark.createDataFrame([(float(x),) for x in v], "v double").groupBy("v").agg(F.count(F.lit(1)).alias("n")), array_values=10)
    assert all(abs(passes[k] - m[k]) < 1e-9 for k in m)


def test_elastic_net_meets_its_conditions():
    r = np.random.default_rng(5)
    x = np.abs(r.normal(size=(400, 6)))
    y = x @ np.array([1.0, 0, 0.5, 0, 0, 2.0]) - 0.3 * x[:, 1] + 0.1 * r.normal(size=400)
    full = np.column_stack([np.ones(400), x, y])
    w, b = L.elastic_net(full.T @ full)
    assert (w >= 0).all() and w[1] == 0 and L.optimality_gap(full.T @ full, w) < 1e-9
    assert abs(L.squared_error(full.T @ full, w, b) - np.mean((y - x @ w - b) ** 2)) < 1e-9


# The reference's own test strategy, on generated tables.
def test_folds_cover_all_rows_without_overlap(spark):
    from terrane.plans.relational_queries import folds

    rows = folds(spark, "/root/testdata/sf0.001").collect()
    assert len({x.obs_id for x in rows}) == len(rows) == 500 and {x.fold for x in rows} == set(range(5))


def test_simulated_attribution_sums_to_one(spark):
    m = M.decomposition(spark, "complementary", 24, 32, 4)
    assert m.count() == 4 * 24 * 32
    sums = m.where("tissue").groupBy("row", "col").agg(F.sum("attribution").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert tuple(sums) == (1.0, 1.0)
    assert m.groupBy("enh").agg(F.sum(F.col("activity") * F.col("attribution")).alias("c")).where("c > 0").count() == 2
    with pytest.raises(ValueError):
        M.decomposition(spark, "nothing")


def test_several_drivers_beat_the_best_one(spark):
    m = M.decomposition(spark, "complementary", 24, 32, 4).where("tissue")
    wide = m.groupBy("row", "col").agg(F.first("gene").alias("y"), *[F.max(F.when(F.col("enh") == i, F.col("activity"))).alias(f"x{i}") for i in range(4)])
    train, held = (L.grams(wide.where(c), [f"x{i}" for i in range(4)], "y")[None] for c in ("row % 3 <> 0", "row % 3 = 0"))
    w, b = L.elastic_net(train)
    every = L.squared_error(held, w, b)
    ones = []
    for i in range(4):
        at = np.ix_([0, 1 + i, 5], [0, 1 + i, 5])
        v, c = L.elastic_net(train[at], alpha=0.0)
        ones.append(L.squared_error(held[at], v, c))
    assert every < min(ones)


def test_set_encoder_is_equivariant_and_ignores_padding():
    r = np.random.default_rng(1)
    maps, w = r.random((4, 6, 7)), setmodel.weights(3)
    logits, scale = setmodel.encode(maps, w)
    order = np.array([2, 0, 3, 1])
    logits2, scale2 = setmodel.encode(maps[order], w)
    assert np.allclose(logits[order], logits2, atol=1e-9) and np.allclose(scale[order], scale2, atol=1e-9) and (scale >= 0).all()
    padded, pscale = setmodel.encode(np.concatenate([maps, r.random((1, 6, 7))]), w, np.array([True] * 4 + [False]))
    assert np.allclose(padded[:4], logits, atol=1e-9) and not padded[4].any() and pscale[4] == 0


def test_mixed_simulation_has_its_classes(spark):
    m = M.mixed_complexity(spark)
    got = {x.truth: x.n for x in m.select("enh", "truth").distinct().groupBy("truth").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"core_concordant": 10, "regional_specific": 3, "regional_redundant": 2, "unsupported": 5}


def test_mixed_simulation_recovers_core_without_false_regional(spark):
    from terrane.plans.catalogue import QUERIES

    rows = QUERIES["simulated_recovery"](spark, "/root/testdata/sf0.001").collect()
    assert sum(x.n for x in rows if x.truth == "core_concordant" and x.predicted_class == "core_concordant") == 10
    assert not [x for x in rows if x.truth == "unsupported" and x.predicted_class == "regional_candidate"]


def test_elbow(spark):
    f = lambda v: spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(v)], "k int, s double")
    assert E.elbow(f([5.0, 0.0]), "k", "s").first().elbow == 1 and E.elbow(f([]), "k", "s").first().elbow == 0
    v = [100.0, 50.0, 2.0, 1.5, 1.2, 1.0]
    t = np.log10(np.array(v) + 1e-6)
    x = np.linspace(0, 1, len(v))
    assert E.elbow(f(v), "k", "s").first().elbow == int(np.argmax((1 - x) - (t - t[-1]) / (t[0] - t[-1])) + 1)


def test_chunks_resume(spark, tmp_path):
    f = spark.createDataFrame([(c, float(c)) for c in range(4)], "chunk int, v double")
    calls = []

    def work(frame):
        calls.append(sorted(r.chunk for r in frame.collect()))
        return frame

    T.run_chunks(f.where("chunk < 2"), "chunk", work, f"{tmp_path}/o")
    assert T.run_chunks(f, "chunk", work, f"{tmp_path}/o").count() == 4 and calls == [[0, 1], [2, 3]]


def test_audit_columns(spark):
    f = spark.createDataFrame([(1, None), (2, "x")], "a int, `b.c` string")
    assert [tuple(r) for r in T.audit_columns(f).collect()] == [("a", "int", 0), ("b.c", "string", 1)]


def test_table_functions(spark):
    from terrane.functions.table_functions import register

    register(spark)
    assert [tuple(x) for x in spark.sql("select * from parse_intervals('chr1:5-9, 2-10-20,oops')").collect()] == [("chr1", 5, 9, 7), ("2", 10, 20, 15)]
    assert spark.sql("select * from blob(3, 4, 0.0, 0.0, 0.5) where row = 0 and col = 0").first().value == 1.0


def test_command_line(spark, capsys):
    from terrane.__main__ import COMMANDS, main
    from terrane.plans import catalogue

    assert main(["list"]) == 0 and "evidence_screen COR-06" in capsys.readouterr().out
    assert set(COMMANDS.values()) <= set(catalogue.QUERIES)
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", "x"])


def test_random_walk_probabilities_are_harmonic():
    from terrane.operators.masks import walk

    r = np.random.default_rng(3)
    v, there = r.normal(size=(14, 17)).cumsum(0).cumsum(1), r.random((14, 17)) > 0.1
    beta, p = 25.0, walk(v, there, 0.9, 0.4, 25.0)
    scaled = (v - v[there].min()) / (v[there].max() - v[there].min())
    hi, lo = np.quantile(scaled[there], 0.9), np.quantile(scaled[there], 0.4)
    assert np.isnan(p[~there]).all()
    for i, j in np.argwhere(there):
        if scaled[i, j] >= hi or scaled[i, j] <= lo:
            assert p[i, j] == (scaled[i, j] >= hi)
            continue
        near = [(a, b) for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= a < 14 and 0 <= b < 17 and there[a, b]]
        w = [np.exp(-beta * (scaled[i, j] - scaled[x]) ** 2) for x in near]
        assert abs(p[i, j] - (np.dot(w, [p[x] for x in near]) / sum(w) if near else 0)) < 1e-6


def test_contour_grows_within_its_bounds():
    from terrane.operators.masks import contour

    y, x = np.indices((40, 50))
    v = np.exp(-((y - 20) ** 2 + (x - 25) ** 2) / 120.0)
    there = np.ones(v.shape, bool)
    mask, few = contour(v, there, 0.95, 0.84, 0.7, 20), contour(v, there, 0.95, 0.84, 0.7, 1)
    assert (mask[few]).all() and mask.sum() >= few.sum() >= 0.05 * v.size and (v[mask] >= np.quantile(v, 0.84)).all()


def test_components_of_groups_that_a_hash_could_mix(spark):
    from terrane.operators import raster as S

    rows = [(g, 0, c) for g in range(40) for c in (0, 1, 3)]
    got = S.components(spark.createDataFrame(rows, "gene int, row int, col int"), 5, 4, by=["gene"]).collect()
    assert {(x.gene, x.col, x.component) for x in got} == {(g, c, 0 if c < 2 else 3) for g, _, c in rows}


def test_gate_policies():
    assert L.gate_opens([0.1, 0.1, 0.1, -0.005]) and not L.gate_opens([0.1, 0.1, 0.1, -0.02]) and not L.gate_opens([0.001] * 4)
    assert L.gate_opens([0.1, 0.1, 0.1, -0.5], "majority") and not L.gate_opens([0.1, 0.1, -0.1], "majority")
    assert L.gate_opens([0.001], "strict") and not L.gate_opens([0.1, 0.0], "strict")
    for bad in (([], "robust"), ([0.1], "lenient")):
        with pytest.raises(ValueError):
            L.gate_opens(*bad)


def test_simulated_noise_is_smooth_and_scaled(spark):
    m = M.decomposition(spark, "single", noise=0.04).where("tissue and enh = 0")
    clean = M.decomposition(spark, "single").where("tissue and enh = 0").select("row", "col", F.col("gene").alias("clean"))
    rows = {(x.row, x.col): x.gene - x.clean for x in m.join(clean, ["row", "col"]).where("clean > 0.2").collect()}
    v = np.array(list(rows.values()))
    near = np.array([(rows[r, c], rows[r, c + 1]) for r, c in rows if (r, c + 1) in rows])
    assert 0.02 < v.std() < 0.06 and np.corrcoef(near.T)[0, 1] > 0.6


def test_torus_in_blocks(spark):
    """Nulls of a torus that is cut into blocks are those of the whole one; shifts wrap, cells and a value are missing."""
    rows, cols, rng = 23, 5, np.random.default_rng(3)
    shifts = [(3, 1), (10, 4), (22, 0), (0, 2)]
    pixels = [(g, 0, k // cols, k % cols, int(k % cols > 2), float(rng.normal()), float(rng.normal())) for g in range(2) for k in range(rows * cols) if k % 11]
    pixels[7] = (*pixels[7][:5], None, 1.0)
    frame = spark.createDataFrame(pixels, "gene int, enh int, row int, col int, domain int, x double, y double")
    wanted = {}
    for g in range(2):
        at = {(p[2], p[3]): p for p in pixels if p[0] == g}
        for k, (dy, dx) in enumerate(shifts):
            local = []
            for d in (0, 1):
                both = [(at[q][5], p[6]) for p in at.values() if p[4] == d and (q := ((p[2] - dy) % rows, (p[3] - dx) % cols)) in at and at[q][5] is not None]
                local.append(round(float(np.corrcoef(np.array(both).T)[0, 1]), 6))
            wanted[g, k] = max(local)
    for cells in (15, 35, 1000):
        found = {(q.gene, q.perm): q.null_max for q in E.toroidal_null(frame, shifts, rows, cols, cells=cells).collect()}
        assert found == pytest.approx(wanted, abs=2e-6)


def test_ranks_by_slices(spark):
    """Ranks of groups that several slices hold: ties, one value alone, more rows than slices."""
    rng = random.Random(5)
    rows = [(0, float(rng.choice([0, 0, 0, 1.5, 2, rng.random() * 9]))) for _ in range(300)] + [(1, 4.0)] * 7 + [(2, float(k)) for k in range(50)]
    frame = spark.createDataFrame(rows, "g int, v double")
    placed, sizes, _ = sliced(frame, "v", ["g"])
    assert placed.where("g = 2").select("_slice").distinct().count() > 8
    values = placed.groupBy("g", "_slice", "v").agg(F.count(F.lit(1)).alias("c"))
    found = {(q.g, q.v): q.k for q in centred_ranks(values, sizes, "v", ["g"], "c", "k").collect()}
    for g in range(3):
        own = sorted(v for h, v in rows if h == g)
        for v in set(own):
            first = own.index(v) + 1
            assert found[g, v] == first + (own.count(v) - 1) / 2 - (len(own) + 1) / 2


def test_structure_scores_leave_no_tables(spark):
    """The tables of views, graphs and hot spots go before the scores are returned."""
    from pathlib import Path

    from terrane.operators.lineage import checkpoint_folder
    from terrane.operators.structure import structure_scores

    folder, rng = Path(checkpoint_folder(spark).removeprefix("file:")), random.Random(2)
    rows = [(0, e, k, rng.random(), rng.random(), rng.random(), rng.random(), rng.random()) for e in range(2) for k in range(40)]
    places = {k: (rng.random(), rng.random(), rng.random()) for k in range(40)}
    active = spark.createDataFrame([(g, e, k, x, y, *places[k]) for g, e, k, x, y, *_ in rows], "gene int, enh int, obs_id long, x double, y double, ox double, oy double, oz double")
    before = set(folder.glob("*/*"))
    assert structure_scores(active).count() == 2
    assert not [p for p in set(folder.glob("scratch-*/*")) - before]


def test_closest_points_and_largest_share():
    """Against all pairs: ties, equal points, cells of few points; and the share of the largest component."""
    from terrane.operators.cells import closest, largest_share

    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 65, 300):
        for at in (rng.normal(size=(n, 3)), rng.integers(0, 4, (n, 3)).astype(float), rng.integers(0, 2, (n, 3)).astype(float)):
            ids = rng.permutation(n)
            d = np.round(sum((at[:, None, a] - at[None, :, a]) ** 2 for a in range(3)), 9)
            pairs = {(i, j) for i in range(n) for j in [j for j in np.lexsort((ids, d[i])).tolist() if j != i][:6]}
            u, v = closest(at, ids, 6, 16, 1 << 12)
            assert set(zip(u.tolist(), v.tolist(), strict=True)) == pairs
            low = list(range(n))
            for _ in range(n):
                for i, j in pairs:
                    low[i] = low[j] = min(low[i], low[j])
            assert largest_share(at, ids, 6) == pytest.approx(max(np.bincount(low)) / n)
    assert largest_share(np.array([[np.nan] * 3, [0.0] * 3]), np.array([1, 2]), 6) == 0.5


def test_structure_scores_send_values_to_blocks(spark):
    """As by hand, with drivers that some observations lack; hot spots in tasks and by joins; no row a neighbour, driver and view."""
    from terrane.operators.structure import packed_scores, structure_scores

    rng = random.Random(4)
    places = {k: tuple(rng.random() for _ in range(3)) for k in range(300)}
    rows = [(g, e, k, max(0.0, rng.gauss(0.2, 1)), 0.1 + places[k][0], *places[k]) for g in range(2) for e in range(12) for k in range(300) if (e + k) % 7 or e > 8]
    active = spark.createDataFrame(rows, "gene int, enh int, obs_id long, x double, y double, ox double, oy double, oz double")

    def stages():
        gateway = spark.sparkContext._gateway
        store = spark.sparkContext._jsc.sc().statusStore()
        listed = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s := listed.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(listed.size())}

    before = stages()
    found = {(q.gene, q.enh): (q.diff_structure, q.logfc_structure, q.residual_structure, q.total) for q in structure_scores(active).collect()}
    # A row a neighbour, driver and view would be 2 * 300 * 6 * 12 * 3 = 129,600 rows.
    assert max(n for k, n in stages().items() if k not in before) < 3 * len(rows)
    packed = active.groupBy("gene", "obs_id", "ox", "oy", "oz").agg(F.collect_list(F.struct("enh", "x", "y")).alias("drivers"))
    assert {(q.gene, q.enh): (q.diff_structure, q.logfc_structure, q.residual_structure, q.total) for q in packed_scores(packed, whole=20).collect()} == found

    at = np.array([places[k] for k in range(300)])
    d = np.round(sum((at[:, None, a] - at[None, :, a]) ** 2 for a in range(3)), 9)
    near = [[j for j in np.lexsort((np.arange(300), d[i])).tolist() if j != i][:6] for i in range(300)]
    for e in (0, 3, 10):
        own = {p[2]: (p[3], p[4]) for p in rows if p[0] == 0 and p[1] == e}
        x, y = np.array(list(own.values())).T
        ks = np.array(list(own))
        a, c = (np.minimum(v, q) / q for v, q in ((v, max(np.quantile(v[v > 0], 0.99), 1e-8)) for v in (x, y)))
        slope = np.cov(c, a, bias=True)[0, 1] / c.var()
        scores = []
        for w, raw in enumerate((a - c, np.log2((a + 1e-3) / (c + 1e-3)), a - (a.mean() - slope * c.mean() + slope * c))):
            v = np.round(np.abs(raw), 9)
            z = dict(zip(ks.tolist(), v - v.mean(), strict=True))
            lag = {k: np.mean([z[j] for j in near[k] if j in z]) for k in z if any(j in z for j in near[k])}
            moran = sum(z[k] * lag[k] for k in lag) / sum(z[k] ** 2 for k in lag)
            hot = ks[v >= round(float(np.quantile(v, 0.9)), 9)]
            low = {k: k for k in hot.tolist()}
            pairs = [(i, j) for i in low for j in sorted((k for k in low if k != i), key=lambda k: (d[i, k], k))[:6]]
            for _ in low:
                for i, j in pairs:
                    low[i] = low[j] = min(low[i], low[j])
            share = max(list(low.values()).count(k) for k in low) / len(low)
            scores.append((raw.std() if w == 2 else np.abs(raw).mean()) * (1 + max(moran, 0)) * share)
        assert found[0, e] == pytest.approx((*scores, 0.4 * scores[0] + 0.25 * scores[1] + 0.35 * scores[2]), abs=2e-5)
