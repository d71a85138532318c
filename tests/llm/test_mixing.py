import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from terrane.llm import mixing as M

from .conftest import nasty_rows


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 200))
def test_budget_is_met_as_well_as_any_subset_can(counts, budget):
    sizes = np.array(sorted(counts))
    n = np.array([counts[s] for s in sizes])
    reach = {0}
    for s, c in counts.items():
        reach = {x + s * k for x in reach for k in range(c + 1)}
    take = M.fit_budget(sizes, n, budget)
    assert (take >= 0).all() and (take <= n).all()
    assert int((take * sizes).sum()) == max(x for x in reach if x <= budget)


def test_large_budgets_go_through_the_greedy_steps():
    r = np.random.default_rng(5)
    sizes = np.unique(r.integers(1, 5000, 800))
    counts = r.integers(1, 40, len(sizes))
    total = int((sizes * counts).sum())
    for share in (0.01, 0.3, 0.77, 0.999):
        budget = int(total * share)
        assert abs(int((M.fit_budget(sizes, counts, budget) * sizes).sum()) - budget) <= 1


def best_sum(sizes, counts, budget):
    """The largest sum up to the budget, from all subsets: bit b is set if b words can be reached."""
    mask, full = 1, (1 << (budget + 1)) - 1
    for s, c in zip(sizes, counts):
        for _ in range(c):
            mask |= (mask << int(s)) & full
    return mask.bit_length() - 1


def test_few_long_documents_are_fitted_exactly():
    """What can be reached is reached, however long the documents."""
    for sizes, counts, budget, wanted in (([120_000, 130_000, 140_000], [1, 1, 1], 250_000, 250_000), ([20_000, 30_001], [5, 5], 60_002, 60_002), ([17_000, 40_000, 41_000], [3, 1, 1], 51_000, 51_000)):
        assert int((M.fit_budget(np.array(sizes), np.array(counts), budget) * sizes).sum()) == wanted
    r = np.random.default_rng(8)
    for n in (10, 20, 50):
        sizes = np.unique(r.integers(20_000, 200_000, n))
        counts = np.ones(len(sizes), int)
        for share in (0.05, 0.4, 0.8, 0.97):
            budget = int(sizes.sum() * share)
            assert int((M.fit_budget(sizes, counts, budget) * sizes).sum()) == best_sum(sizes, counts, budget)


def test_long_documents_among_short_ones():
    """A long document isn't shut out because the rest is short."""
    sizes, counts = np.array([7, 900_000, 1_300_000]), np.array([1000, 1, 1])
    for budget in (900_000, 1_300_003, 2_200_000, 906_999):
        assert int((M.fit_budget(sizes, counts, budget) * sizes).sum()) == best_sum(sizes, counts, budget)


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def check(got, rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = water_fill(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1 + 1e-6 or sizes[s] == 0
    assert len(got) == len(rows)


def test_mix(spark):
    r = random.Random(6)
    rows = [(i, "w " * r.randint(0, 30), r.choice(["a", "B", "é", "b", None, "z"] + ["hot"] * 6)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(docs).collect()
    check(got, rows)
    again = {(r.doc_id, r.taken) for r in M.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_hash_ranges_rank_as_one_range_does(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w w", "a" if i % 9 else "b") for i in range(900)], "doc_id long, text string, source string")
    monkeypatch.setattr(M, "RANK_ROWS", 50)
    got = M.mix(docs).collect()
    check(got, [(i, "w w", "a" if i % 9 else "b") for i in range(900)])


def test_edges(spark, nasty):
    got = M.mix(nasty).collect()
    r = [(i, t, s) for i, t, s in nasty_rows()]
    assert len(got) == len(r) and all(x.taken == 0 for x in got if x.size == 0)
    assert M.mix(nasty.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [x.target for x in M.mix(empty).collect()] == [0.0, 0.0]
