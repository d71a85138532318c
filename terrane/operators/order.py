"""Numbers and running sums over all rows in one order, without all rows in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.operators.lineage import cut

#: Keys of a block.
BLOCK = 4096


def prefix_sums(counts: DataFrame, key: str, value: str, out: str = "before", block: int = BLOCK) -> DataFrame:
    """``counts`` (one row a whole-number key) with the sum of ``value`` over all smaller keys.

    Sums within blocks of keys, and over blocks by the same function again, until one block is left.
    """
    sums = _before(counts.select(F.col(key).alias("k"), F.col(value).alias("n")), block)
    return counts.join(sums.select(F.col("k").alias(key), F.col("before").alias(out)), key)


def _before(counts: DataFrame, block: int) -> DataFrame:
    """k, before: of k, n."""
    least = counts.agg(F.min("k")).first()[0] or 0
    blocked = counts.select("k", "n", F.floor((F.col("k") - least) / block).alias("b"))
    totals = cut(blocked.groupBy("b").agg(F.sum("n").alias("n")).toDF("k", "n"))
    before = Window.partitionBy("b").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    own = blocked.select("b", "k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("own"))
    if totals.limit(2).count() < 2:
        return own.select("k", F.col("own").alias("before"))
    return own.join(_before(totals, block).toDF("b", "base"), "b").select("k", (F.col("own") + F.col("base")).alias("before"))


def numbered(frame: DataFrame, order: list[Column], out: str, parts: int | None = None) -> DataFrame:
    """``frame`` with the place (from 1) of each row in the order; rows that tie in it are numbered in any order.

    Rows are sorted by ranges and stored, so that their layout is fixed; a row's place is that in its range, and
    the sizes of the ranges before: one row a range is all that is summed up in one task.
    """
    ranges = parts or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(frame.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    at = laid.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_row"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return at.join(F.broadcast(sizes), "_part").withColumn(out, F.col("_before") + F.col("_row") + 1).drop("_id", "_part", "_row", "_before")


#: Slices of a group's values, and groups whose cuts are broadcast.
SLICES, GROUPS = 16, 100_000


def sliced(frame: DataFrame, value: str, by: list[str]) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """``frame`` with ``_slice``, the place of its value among cuts of its group; by, _slice, _before and _n: rows in smaller slices, rows in all; what adds ``_slice`` to other columns of the same rows.

    Cuts are about where a share of the rows lies; they fix how evenly slices are filled, not what follows from them.
    """
    shares = F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)])
    cuts = cut(frame.groupBy(*by).agg(F.percentile_approx(value, shares, F.lit(200)).alias("_cuts")))
    cuts = F.broadcast(cuts) if cuts.count() <= GROUPS else cuts
    place = lambda rows: rows.join(cuts, by).withColumn("_slice", F.size(F.filter("_cuts", lambda q: q < F.col(value)))).drop("_cuts")
    placed = place(frame)
    groups = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(groups.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = cut(placed.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_c")).select(*by, "_slice", before.alias("_before"), F.sum("_c").over(groups).alias("_n")))
    return placed, sizes, place


def centred_ranks(values: DataFrame, sizes: DataFrame, value: str, by: list[str], count: str, out: str) -> DataFrame:
    """``values`` (one row a group, slice and value, with its ``count`` of rows) with the mean rank of these rows less the group's mean rank.

    A task sorts a slice of a group, in place of the group; equal values are one row.
    """
    sizes = F.broadcast(sizes) if sizes.count() <= GROUPS else sizes
    below = F.sum(count).over(Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranked = values.withColumn("_below", F.coalesce(below, F.lit(0))).join(sizes, [*by, "_slice"])
    return ranked.withColumn(out, F.col("_before") + F.col("_below") + (F.col(count) - F.col("_n")) / 2.0).drop("_below", "_before", "_n", "_slice")
