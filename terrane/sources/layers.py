"""Layers of a matrix that are kept: bucketed by variable and observation, and rebuilt only if their source has changed.

Data of a state of the source lies in a folder of its own, and a manifest, written last, names it: a build that
fails leaves what was there. Both join and group by the buckets' columns without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.sources.tables import read_manifest, write_manifest


def fingerprint(source: DataFrame) -> str:
    """Of a frame that reads files: their names, sizes and times of change, of which none of the data is read."""
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, total = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    return f"{n}-{total or 0}"


def _manifest(spark: SparkSession, path: str) -> dict | None:
    try:
        return read_manifest(spark, f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def kept_layer(source: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, by: list[str], buckets: int, note: str = "") -> tuple[DataFrame, bool]:
    """``build(source)`` as kept under ``path`` in buckets of ``by``, each sorted so, and whether it was built just now.

    It is built if there is none, or if the source's files, the number of buckets, their columns or ``note`` (for what
    ``build`` depends on besides) are not those of the manifest, which says the shape (rows of each column of ``by``), too.
    An empty source gives an empty layer, which is not kept.
    """
    spark = source.sparkSession
    state = {"source": fingerprint(source), "by": by, "buckets": buckets, "note": note}
    found = _manifest(spark, path)
    built = found is None or any(found.get(k) != v for k, v in state.items())
    if built:
        layer = build(source)
        state |= {"data": f"data-{uuid4().hex}", "schema": layer.schema.simpleString().removeprefix("struct<").removesuffix(">")}
        name = f"layer_{uuid4().hex}"
        layer.write.bucketBy(buckets, *by).sortBy(*by).option("path", f"{path}/{state['data']}").saveAsTable(name)
        distinct = spark.table(name).agg(F.count(F.lit(1)).alias("cells"), *[F.countDistinct(c).alias(c) for c in by]).first().asDict()
        spark.sql(f"drop table {name}")
        found = state | {"shape": distinct}
        write_manifest(spark, f"{path}/manifest", found)
    return _table(spark, f"{path}/{found['data']}", found), built


def shape(spark: SparkSession, path: str) -> dict[str, int]:
    """Cells of a kept layer, and distinct values of its buckets' columns."""
    return read_manifest(spark, f"{path}/manifest")["shape"]


def _table(spark: SparkSession, data: str, state: dict) -> DataFrame:
    """The files at ``data`` under a new name, so that Spark knows of the buckets."""
    columns = ", ".join("`{}` {}".format(*x.split(":", 1)) for x in state["schema"].split(","))
    name, by = f"layer_{uuid4().hex}", ", ".join(f"`{c}`" for c in state["by"])
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({by}) sorted by ({by}) into {state['buckets']} buckets location '{data}'")
    return spark.table(name)
