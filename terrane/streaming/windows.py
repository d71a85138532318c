"""Event-time windows over a stream of files; an extension, the reference data model has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.sources.tables import scratch

ROWS = "start timestamp, event_type string, n long, value double, batch long"


def event_windows(spark: SparkSession, folder: str, width: str = "1 hour", late: str = "1 day", out: str | None = None) -> DataFrame:
    """start, event_type, n, value: tumbling windows, as they stand after all that is there has been taken.

    A batch writes the windows that it changed, closed or open, as a partition of its own; the last state of a window
    counts. State is kept for windows up to ``late`` behind the newest event, so rows of one run may come in any order, and
    a run with the same ``out`` goes on from the last one's checkpoint: only what is later than that against earlier
    runs is left out.
    """
    path = f"{folder}/events.parquet"
    out = out or scratch(spark)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    windows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))

    def keep(batch: DataFrame, number: int) -> None:
        changed = batch.select(F.col("window.start").alias("start"), "event_type", "n", "value", F.lit(number).cast("long").alias("batch"))
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/rows")

    windows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema(ROWS).parquet(f"{out}/rows").groupBy("start", "event_type").agg(F.max_by(F.struct("n", "value"), "batch").alias("s"))
    return last.select("start", "event_type", "s.n", "s.value")
