"""Sparse matrices as row pointers, indices and values, made from cells and read back, in either direction.

A compressed matrix is two tables: ``pointers`` (row, start, stop) and ``entries`` (at, index, value), where a
row's entries are those with start <= at < stop. Neither direction needs all rows in one place: places follow
from prefix sums over blocks of rows, and entries find their rows block by block of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.operators.lineage import cut
from terrane.operators.order import prefix_sums
from terrane.sources.tables import read_manifest, write_manifest

#: Indexes, and places, of a block.
BLOCK = 4096


def compress(cells: DataFrame, row: str, index: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(pointers, entries) of cells, one row each, ordered by row, then index; rows without cells have no pointer.

    Cells of one place are kept each. A row's cells are numbered in blocks of indexes, so a long row is not one task.
    """
    named = cells.select(F.col(row).cast("long").alias("row"), F.col(index).cast("long").alias("index"), F.col(value).alias("value"), F.floor(F.col(index) / BLOCK).alias("part"))
    parts = cut(named.groupBy("row", "part").agg(F.count(F.lit(1)).alias("n")))
    rows = prefix_sums(parts.groupBy("row").agg(F.sum("n").alias("n")), "row", "n", "start")
    pointers = cut(rows.select("row", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n")).cast("long").alias("stop")))
    within = Window.partitionBy("row").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.withColumn("_base", F.coalesce(F.sum("n").over(within), F.lit(0))).join(pointers, "row").select("row", "part", (F.col("start") + F.col("_base")).alias("base"))
    place = F.row_number().over(Window.partitionBy("row", "part").orderBy("index", "value")) - 1
    entries = named.withColumn("_place", place).join(bases, ["row", "part"]).select((F.col("base") + F.col("_place")).cast("long").alias("at"), "index", "value")
    return pointers, entries


def expand(pointers: DataFrame, entries: DataFrame, row: str = "row", index: str = "index", value: str = "value", block: int = BLOCK) -> DataFrame:
    """The cells (row, index, value) of a compressed matrix; pointers of empty rows are fine, and rows without a pointer are left out.

    A row is marked where it starts and at the start of each block of places that it goes on into, so that within
    a block each entry's row is the last mark before it, whatever rows start or end there.
    """
    full = pointers.where("stop > start").withColumn("_own", F.struct("row", "stop"))
    blocks = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))
    nothing = [F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in ("index", "value")]
    marks = full.select("start", "_own", F.explode(blocks).alias("_block")).select("_block", F.greatest(F.col("start"), F.col("_block") * block).alias("at"), F.lit(0).alias("_kind"), "_own", *nothing)
    seen = entries.select(F.floor(F.col("at") / block).alias("_block"), "at", F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_own"].dataType).alias("_own"), "index", "value")
    last = F.last("_own", ignorenulls=True).over(Window.partitionBy("_block").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = marks.unionByName(seen).withColumn("_own", last).where("_kind = 1 and at < _own.stop")
    return found.select(F.col("_own.row").alias(row), F.col("index").alias(index), F.col("value").alias(value))


def transpose(pointers: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same matrix by columns: indices become rows."""
    return compress(expand(pointers, entries), "index", "row", "value")


def write_compressed(pointers: DataFrame, entries: DataFrame, path: str, shape: tuple[int, int]) -> None:
    """Both tables, entries by ranges of places and in order, and then the manifest, without which there is no matrix."""
    pointers.write.mode("overwrite").parquet(f"{path}/pointers")
    entries.repartitionByRange("at").sortWithinPartitions("at").write.mode("overwrite").parquet(f"{path}/entries")
    write_manifest(pointers.sparkSession, f"{path}/manifest", {"shape": list(shape)})


def read_compressed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """pointers, entries and shape."""
    return spark.read.parquet(f"{path}/pointers"), spark.read.parquet(f"{path}/entries"), tuple(read_manifest(spark, f"{path}/manifest")["shape"])


def read_rows(spark: SparkSession, path: str, wanted: Column) -> DataFrame:
    """The cells of rows for which ``wanted`` (over ``row``) holds; the files' statistics skip what is not between the first and the last."""
    pointers, entries, _ = read_compressed(spark, path)
    pointers = pointers.where(wanted)
    lo, hi = pointers.agg(F.min("start"), F.max("stop")).first()
    return expand(pointers, entries.where((F.col("at") >= (lo or 0)) & (F.col("at") < (hi or 0))))
