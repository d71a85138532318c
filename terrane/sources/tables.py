"""Readers and writers: delimited text, manifests, star schemas, resumable chunks."""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.lineage import checkpoint_folder


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/scratch-{uuid4().hex}"


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated text with a header, plain or compressed, under a given schema: no inference pass."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def write_tsv(frame: DataFrame, path: str, compression: str = "none") -> None:
    """Tab-separated text with a header; committed as a whole, so readers never see a part of it."""
    frame.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", compression).csv(path)


def write_manifest(spark: SparkSession, path: str, values: dict) -> None:
    """One JSON object."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The object that ``write_manifest`` wrote."""
    return json.loads(spark.read.text(path).first()[0])


def write_star(parts: dict[str, DataFrame], path: str, sort: dict[str, str] | None = None) -> None:
    """Parquet folders by name; a fact sorted by a column gets row-group statistics that its filters can use."""
    for name, frame in parts.items():
        if sort and name in sort:
            frame = frame.repartitionByRange(sort[name]).sortWithinPartitions(sort[name])
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def run_chunks(frame: DataFrame, chunk: str, work: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Applies ``work`` to the chunks that ``path`` doesn't hold yet, in one job, and returns all results.

    A rerun after a failure starts from what was committed: finished chunks are anti-joined away.
    """
    spark = frame.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        frame = frame.join(spark.read.parquet(path).select(chunk).distinct(), chunk, "left_anti")
    work(frame).write.mode("append").partitionBy(chunk).parquet(path)
    return spark.read.parquet(path)


def audit_columns(frame: DataFrame) -> DataFrame:
    """One row a column: its type and count of nulls."""
    counts = frame.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in frame.columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(t).alias("type"), F.col(f"`{c}`").alias("nulls")) for c, t in frame.dtypes])).alias("x")).select("x.*")
