"""Cutting lineage so that iterative jobs survive lost executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one of this session, in local mode only.

    On a cluster a machine's own folder would be lost with the machine, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    if (found := sc.getCheckpointDir()) is None:
        if (found := spark.conf.get("spark.checkpoint.dir", None)) is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="terrane-checkpoint-")
        sc.setCheckpointDir(found)
    return found


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` computed once and stored in the shared checkpoint folder, without its lineage."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of this session, if the session is still there: at the end of the program it may not be."""
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001  the session is gone: its folder is the cluster's to clear
        return


def store(frame: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table: for frames that are read more than once, by some of their columns."""
    spark = frame.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/table-{uuid4().hex}"
    frame.write.parquet(path)
    atexit.register(discard, spark, path)
    return spark.read.parquet(path)


class Scratch:
    """Tables of one step, in the shared checkpoint folder; each goes when the step is done with it, all at ``close``.

    Files of ``cut`` stay as long as the program, so steps that store much, or in rounds, keep it here. What is read
    from a table lazily must be computed before the table goes.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []
        self.base = f"{checkpoint_folder(spark).rstrip('/')}/scratch-{uuid4().hex}"
        atexit.register(discard, spark, self.base)

    def keep(self, frame: DataFrame) -> DataFrame:
        """``frame`` computed once and stored as Parquet."""
        path = f"{self.base}/{uuid4().hex}"
        frame.write.parquet(path)
        kept = self.spark.read.parquet(path)
        self.tables.append((kept, path))
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Removes the tables of these frames, as ``keep`` gave them, and the shuffle files of what was made of them."""
        for frame in frames:
            for kept, path in self.tables:
                if kept is frame:
                    discard(self.spark, path)
        self.tables = [t for t in self.tables if not any(t[0] is f for f in frames)]
        release(self.spark)

    def close(self) -> None:
        """Removes all tables."""
        self.tables = []
        discard(self.spark, self.base)
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Lets the cluster drop shuffle files that nothing refers to any more.

    Spark drops them when the driver collects its garbage, by default every half hour: a job of many steps
    asks for it between steps, so that its disk holds the steps at work only.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
