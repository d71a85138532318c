"""Session construction shared by tests, the benchmark and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that every terrane job relies on; a cluster's own values win for everything else.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, name: str = "terrane", memory: str = "8g") -> SparkSession:
    """A local session of the given number of threads (default: BENCH_CPUS, else 8)."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config(map=DEFAULTS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
