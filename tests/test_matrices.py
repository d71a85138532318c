import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from terrane.operators import order as O
from terrane.sources import layers as L
from terrane.sources import sparse as S


def cells(n=4000):
    """A row of half of all cells, empty rows, and a cell that is there twice."""
    r = random.Random(3)
    found = {(7, c) for c in range(0, 2 * n, 2)} | {(r.choice((0, 1, 2, 5, 40, 41, 9000)), r.randrange(3000)) for _ in range(n)}
    rows = [(a, b, float(r.randint(1, 9))) for a, b in found]
    return [*rows, rows[5]]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(cells(), "obs long, var long, v double").repartition(5).cache()


def tuples(f):
    return Counter(tuple(x) for x in f.collect())


def test_compressed_form(spark, frame):
    pointers, entries = S.compress(frame, "obs", "var", "v")
    rows = sorted(cells())
    assert [(x["at"], x["index"], x["value"]) for x in sorted(entries.collect())] == [(k, b, v) for k, (_, b, v) in enumerate(rows)]
    starts = {a: [k for k, x in enumerate(rows) if x[0] == a] for a in {x[0] for x in rows}}
    assert {x.row: (x.start, x.stop) for x in pointers.collect()} == {a: (k[0], k[-1] + 1) for a, k in starts.items()}


@pytest.mark.parametrize("block", [7, 4096])
def test_round_trip(frame, block):
    pointers, entries = S.compress(frame, "obs", "var", "v")
    empty = pointers.sparkSession.createDataFrame([(3, 100, 100), (50, 0, 0)], pointers.schema)
    assert tuples(S.expand(pointers.unionByName(empty), entries, block=block)) == Counter(cells())


def test_transposed_twice_is_the_same(frame):
    first = S.compress(frame, "obs", "var", "v")
    columns = S.transpose(*first)
    assert tuples(S.expand(*columns, row="c", index="r").select("r", "c", "value")) == Counter(cells())
    again = S.transpose(*columns)
    assert tuples(again[0]) == tuples(first[0]) and tuples(again[1]) == tuples(first[1])


def test_files_and_chosen_rows(spark, frame, tmp_path):
    S.write_compressed(*S.compress(frame, "obs", "var", "v"), f"{tmp_path}/m", (9001, 8000))
    assert S.read_compressed(spark, f"{tmp_path}/m")[2] == (9001, 8000)
    for wanted in ([1, 40], [7], [6], []):
        found = S.read_rows(spark, f"{tmp_path}/m", F.col("row").isin(*wanted) if wanted else F.lit(False))
        assert tuples(found) == Counter(x for x in cells() if x[0] in wanted)
    plan = S.read_rows(spark, f"{tmp_path}/m", F.col("row") == 40)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at" in plan and "LessThan(at" in plan


def test_prefix_sums(spark):
    r = random.Random(1)
    rows = [(k, r.randint(0, 9)) for k in r.sample(range(-500, 100_000), 300)]
    found = {x.k: x.before for x in O.prefix_sums(spark.createDataFrame(rows, "k long, n long"), "k", "n", block=10).collect()}
    assert found == {k: sum(n for j, n in rows if j < k) for k, _ in rows}


def test_numbers_in_one_order(spark):
    r = random.Random(2)
    rows = [(i, r.choice((None, 1.0, 2.0, float("nan"))) if r.random() < 0.5 else r.random()) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, v double").repartition(5)
    found = {x.id: x.k for x in O.numbered(frame, [F.desc_nulls_last("v"), F.col("id")], "k", 7).collect()}
    assert [i for i, _ in sorted(found.items(), key=lambda x: x[1])] == [x.id for x in frame.orderBy(F.desc_nulls_last("v"), "id").collect()] and sorted(found.values()) == list(range(1, 501))
    same = O.numbered(spark.createDataFrame([(1,)] * 50, "v long"), [F.col("v")], "k").collect()
    assert sorted(x.k for x in same) == list(range(1, 51)) and O.numbered(frame.limit(0), [F.col("v")], "k").count() == 0


def test_empty_matrix(spark, frame):
    pointers, entries = S.compress(frame.limit(0), "obs", "var", "v")
    assert pointers.count() == entries.count() == S.expand(pointers, entries).count() == 0


def test_kept_layer(spark, tmp_path):
    """Built once, read again, rebuilt when the source or what it is built by changes; joins and groups without a shuffle."""
    source = lambda: spark.read.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(i, i % 5, float(i)) for i in range(100)], "obs long, var int, v double").write.parquet(f"{tmp_path}/in")
    calls = []

    def build(f):
        calls.append(1)
        return f.select("obs", "var", F.log1p("v").alias("v"))

    keep = lambda note="": L.kept_layer(source(), build, f"{tmp_path}/kept", ["var", "obs"], 4, note)
    first, built = keep()
    wanted = tuples(source().select("obs", "var", F.log1p("v")))
    assert built and tuples(first) == wanted and L.shape(spark, f"{tmp_path}/kept") == {"cells": 100, "var": 5, "obs": 100}
    second, built = keep()
    assert not built and len(calls) == 1 and tuples(second) == wanted
    spark.createDataFrame([(500, 1, 2.0)], "obs long, var int, v double").write.mode("append").parquet(f"{tmp_path}/in")
    third, built = keep()
    assert built and third.count() == 101 and tuples(second) == wanted
    assert keep("other")[1] and not keep("other")[1] and len(calls) == 3
    other, _ = L.kept_layer(source(), lambda f: f.select("obs", "var", (F.col("v") * 2).alias("w")), f"{tmp_path}/twice", ["var", "obs"], 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = third.join(other, ["var", "obs"])
        assert joined.count() == 101 and "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
        grouped = third.groupBy("var", "obs").agg(F.sum("v"))
        assert grouped.count() == 101 and "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_failed_build_leaves_what_was_there(spark, tmp_path):
    spark.range(20).write.parquet(f"{tmp_path}/in")
    source = spark.read.parquet(f"{tmp_path}/in")
    kept, _ = L.kept_layer(source, lambda f: f, f"{tmp_path}/kept", ["id"], 2)
    with pytest.raises(Exception, match="broken"):
        L.kept_layer(source, lambda f: f.select(F.raise_error(F.lit("broken")).alias("id")), f"{tmp_path}/kept", ["id"], 2, "new")
    again, built = L.kept_layer(source, lambda f: f, f"{tmp_path}/kept", ["id"], 2)
    assert not built and again.count() == kept.count() == 20
