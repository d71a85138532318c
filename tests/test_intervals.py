import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from terrane.operators import intervals as I

R = random.Random(12)


def events(spark, n, seed, names):
    """99 of 100 rows have one key; a few have no key or no place, and many places are equal."""
    r = random.Random(seed)
    rows = [(i, 7 if r.random() < 0.99 else r.choice((1, 2, None)), r.randint(0, 900) if r.random() < 0.98 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{names[0]} long, k int, {names[1]} long").repartition(4)


@pytest.mark.parametrize("rows_of, within", [(20, None), (20, 5), (5000, None)])
def test_as_of_join_of_a_hot_key(spark, rows_of, within):
    left, lf = events(spark, 900, 1, ("i", "t"))
    right, rf = events(spark, 400, 2, ("j", "u"))
    found = {r.i: None if r.found is None else (r.found.j, r.found.u) for r in I.as_of_join(lf, rf, ["k"], "t", "u", "j", within, rows_of).collect()}
    wanted = {}
    for i, k, t in left:
        near = [(u, j) for j, c, u in right if None not in (k, t, u) and c == k and u <= t and (within is None or u >= t - within)]
        wanted[i] = max(near)[::-1] if near else None
    assert found == wanted and sum(v is not None for v in wanted.values()) > 100


def test_as_of_join_without_rows(spark):
    _, lf = events(spark, 30, 1, ("i", "t"))
    _, rf = events(spark, 30, 2, ("j", "u"))
    assert {r.found for r in I.as_of_join(lf, rf.limit(0), ["k"], "t", "u", "j").collect()} == {None}
    assert I.as_of_join(lf.limit(0), rf, ["k"], "t", "u", "j").count() == 0


def test_range_frame_of_a_hot_key(spark):
    rows, frame = events(spark, 800, 3, ("i", "t"))
    found = {r.i: (r.n, r.s) for r in I.range_frame(frame, ["k"], "t", 10, {"n": F.count(F.lit(1)), "s": F.sum("i")}).collect()}
    wanted = {}
    for i, k, t in rows:
        near = [j for j, c, u in rows if c == k and ((u is None) if t is None else u is not None and t - 10 <= u <= t)]
        wanted[i] = (len(near), sum(near))
    assert found == wanted


@pytest.mark.parametrize("width", [1, 50])
def test_overlaps_with_a_very_long_interval(spark, width):
    def side(n):
        rows = [(i, 7 if R.random() < 0.9 else R.choice((1, None)), s, s + R.choice((0, 1, 3, 40, 700))) for i, s in enumerate(R.choices(range(-500, 20_000), k=n))]
        return [*rows, (9000, 7, -10, 5_000_000_000), (9001, 1, None, 5), (9002, 7, 40, 39), (9003, 7, 100, 200), (9003, 7, 100, 200)]

    left, right = side(200), side(150)
    make = lambda rows: spark.createDataFrame(rows, "i long, k int, s long, e long").repartition(3)
    found = Counter((r.a.i, r.b.i) for r in I.overlap_join(make(left), make(right), ["k"], "s", "e", width).collect())
    assert found == Counter((a[0], b[0]) for a in left for b in right if None not in (*a, *b) and a[1] == b[1] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3])
    assert max(found.values()) == 4 and I._levels(make(left), "s", "e", width, 8).agg(F.max("_level")).first()[0] >= 8
    assert I.overlap_join(make(left).limit(0), make(right), ["k"], "s", "e", width).count() == 0
