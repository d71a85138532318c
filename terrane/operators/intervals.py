"""Joins and frames along a line (time, or positions on a chromosome), for keys that may hold most rows.

No key is one group here: the line is cut into blocks, groups are a key's rows of one block, and what a block
needs of those before it is a single row (as-of joins), or the rows within reach of its start (frames).
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.operators.lineage import cut

#: Blocks that a line is cut into at most, each of about as many rows; rows for which a block is worth it.
BLOCKS, ROWS = 512, 5000


def _blocked(rows: DataFrame, at: str, rows_of: int, out: str) -> DataFrame:
    """``rows`` with the number of their block, by quantiles of ``at``; rows without a place are block 0."""
    n = rows.count()
    blocks = min(BLOCKS, n // rows_of)
    cuts = sorted(set(rows.select(F.col(at).cast("double").alias("t")).where("not isnan(t)").approxQuantile("t", [k / blocks for k in range(1, blocks)], 0.5 / blocks))) if blocks > 1 else []
    if not cuts:
        return rows.withColumn(out, F.lit(0.0))
    placed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_place", outputCol=out, handleInvalid="keep")
    return placed.transform(rows.withColumn("_place", F.coalesce(F.col(at).cast("double"), F.lit(-float("inf"))))).drop("_place")


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], at: str, to: str, tie: str, within: float | None = None, rows_of: int = ROWS) -> DataFrame:
    """left and ``found``: right's row with the largest ``to`` up to ``at`` of the same key, as a struct; null if there is none.

    Of equal ``to`` the largest ``tie`` wins. ``within``: only rows with ``to`` >= ``at`` - within count. Both sides are one
    sorted union, cut into blocks: in its block a row takes the last of right before it, else what the key's blocks
    before have left, one row each. Rows without key or place find nothing and are kept.
    """
    key = [F.col(f"`{c}`") for c in by]
    asked = left.select(*[c.alias(f"_k{i}") for i, c in enumerate(key)], F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"))
    given = right.where(F.col(to).isNotNull()).select(*[c.alias(f"_k{i}") for i, c in enumerate(key)], F.col(to).alias("_t"), F.lit(0).alias("_kind"), F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("_right"))
    both = cut(_blocked(asked.unionByName(given, allowMissingColumns=True), "_t", rows_of, "_block"))
    keys, order = [f"_k{i}" for i in range(len(by))], F.struct(F.col("_t"), F.col(f"_right.{tie}"))
    in_block = Window.partitionBy(*keys, "_block").orderBy("_t", "_kind", f"_right.{tie}").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("_own", F.last("_right", ignorenulls=True).over(in_block)).where("_kind = 1")
    lasts = both.where("_kind = 0").groupBy(*keys, "_block").agg(F.max_by("_right", order).alias("_last"))
    places = both.select(*keys, "_block").distinct().join(lasts, [*keys, "_block"], "left")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).where("_before is not null").select(*keys, "_block", "_before")
    found = own.join(carried, [*keys, "_block"], "left").withColumn("_found", F.coalesce("_own", "_before"))
    near = F.col("_t").isNotNull() if within is None else F.col(f"_found.{to}") >= F.col("_t") - within
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], near)
    return found.select("_left.*", F.when(known, F.col("_found")).alias("found"))


def range_frame(rows: DataFrame, by: list[str], at: str, reach: int, values: dict[str, Column], blocks_of: int = 4) -> DataFrame:
    """``rows`` with aggregates over those of the same key with at - reach <= place <= at, as window frames are.

    ``values``: aggregate columns by name. Blocks are ``blocks_of`` times the reach, so a quarter of the rows are
    carried on into the next block as well, and no group is longer than a block. Rows without a place, whose frames have
    the key's other such rows, are a block of their own.
    """
    width = reach * blocks_of
    block = F.floor(F.col(at) / width)
    carried = rows.select("*", F.explode(F.when(F.col(at).isNull(), F.array(F.struct(F.lit(None).cast("long").alias("b"), F.lit(True).alias("own")))).otherwise(F.filter(
        F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block + 1).alias("b"), F.lit(False).alias("own"))), lambda x: x["own"] | (F.col(at) >= x["b"] * width - reach)
    ))).alias("_in"))
    frame = Window.partitionBy(*by, "_in.b").orderBy(at).rangeBetween(-reach, 0)
    return carried.select(*rows.columns, *[v.over(frame).alias(name) for name, v in values.items()], F.col("_in.own").alias("_own")).where("_own").drop("_own")


def _levels(rows: DataFrame, start: str, end: str, width: int, fan: int) -> DataFrame:
    """``rows`` with the level at which an interval meets two bins at most: bins are width * fan ^ level long."""
    length = F.greatest(F.col(end) - F.col(start), F.lit(1))
    level = F.greatest(F.lit(0), F.ceil(F.log(length / width) / F.log(F.lit(float(fan)))).cast("int"))
    return rows.where(F.col(start) < F.col(end)).withColumn("_level", level)


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, width: int, fan: int = 8) -> DataFrame:
    """by, a and b (structs of the sides' columns): all pairs with equal key whose intervals [start, end) share a point.

    Intervals go to bins of about their length, so a very long one is in two bins and not in thousands, and to the bins
    above that hold intervals of the other side. A pair meets at the longer one's level, in the bin where the later
    of their starts is, once. Empty intervals and those without a key, start or end meet nothing.
    """
    sides = {n: cut(_levels(f, start, end, width, fan)) for n, f in (("a", left), ("b", right))}
    used = {n: sorted(r[0] for r in f.select("_level").distinct().collect()) for n, f in sides.items()}

    def binned(n: str, other: str) -> DataFrame:
        f = sides[n]
        levels = F.array(*[F.lit(k) for k in sorted({*used[n], *used[other]})]) if used[n] else F.array().cast("array<int>")
        rows = f.select(*by, F.struct(*[F.col(f"`{c}`") for c in f.columns if c != "_level"]).alias(n), F.col("_level").alias(f"_own_{n}"), F.col(start).alias(f"_s_{n}"), F.col(end).alias("_e"), F.explode(F.filter(levels, lambda k: k >= F.col("_level"))).alias("_at"))
        size = F.lit(width) * F.pow(F.lit(fan), F.col("_at")).cast("long")
        return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"_s_{n}") / size), F.floor((F.col("_e") - 1) / size)))).withColumn("_size", size).drop("_e")

    a, b = binned("a", "b"), binned("b", "a").drop("_size")
    met = a.join(b, [*by, "_at", "_bin"]).where((F.col("_at") == F.greatest("_own_a", "_own_b")) & (F.floor(F.greatest("_s_a", "_s_b") / F.col("_size")) == F.col("_bin")))
    return met.where((F.col(f"a.{start}") < F.col(f"b.{end}")) & (F.col(f"b.{start}") < F.col(f"a.{end}"))).select(*by, "a", "b")
