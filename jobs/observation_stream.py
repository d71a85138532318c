"""Evidence screen over observations that keep arriving.

Each run takes the Parquet files that are new since the last one (a file stream with a checkpoint, until
all that is there has been taken), adds their moments by target, driver and domain as one more part, and
screens all parts together. Nothing of the observations is read again, however many have come before.

A batch's moments are one partition that its number names, so a batch that is run again after a failure
replaces its own rows. A run without new files screens the same parts and writes the same rows. Files
are taken once each, as Spark's file streams do: a file that changes later isn't read again.

    python -m jobs.observation_stream --config jobs/observation_stream.yaml
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import evidence as E
from terrane.sources.config import read_config

log = logging.getLogger("jobs.observation_stream")
PART = "gene int, enh int, domain int, n long, mx double, my double, cxx double, cyy double, cxy double, batch long"

SCREEN = "enh int, max_regional_concordance double, best_domain int, best_domain_size long, global_concordance double, local_advantage double, regional_specificity double, regional_evidence_score double, predicted_class string, gene int"


@dataclass(frozen=True)
class Config:
    """Paths, where targets and drivers are in an observation's vector, and the classes' thresholds."""

    observations: str  # a folder, or a pattern of files
    out: str
    checkpoint: str
    first_target: int = 3
    targets: int = 8
    first_driver: int = 11
    drivers: int = 53
    files_per_batch: int = 64
    evidence: E.Thresholds = field(default_factory=E.Thresholds)


def pairs(observations: DataFrame, c: Config) -> DataFrame:
    """gene, enh, domain, x, y: each driver of each target at each observation, both not negative.

    The domain is the label (null: -1). Values that are missing (null, NaN, or a short vector) leave out their pairs.
    """
    rows = observations.select(F.coalesce("label", F.lit(-1)).cast("int").alias("domain"), "embedding")
    genes = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(c.targets - 1))).alias("gene"))
    both = genes.select("*", F.explode(F.sequence(F.lit(0), F.lit(c.drivers - 1))).alias("enh"))
    value = lambda at: F.nanvl(F.get("embedding", at).cast("double"), F.lit(None).cast("double"))
    seen = both.select("gene", "enh", "domain", value(F.col("enh") + c.first_driver).alias("x"), value(F.col("gene") + c.first_target).alias("y"))
    return seen.where("x is not null and y is not null").select("gene", "enh", "domain", F.greatest("x", F.lit(0.0)).alias("x"), F.greatest("y", F.lit(0.0)).alias("y"))


def take_new(spark: SparkSession, c: Config) -> tuple[int, int]:
    """Adds the moments of all files that are new; returns the number of observations and of batches."""
    taken: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        found = E.domain_moments(pairs(batch, c)).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{c.out}/moments")
        taken.append(batch.count())
        log.info("batch %d: read %d observations of %s", number, taken[-1], c.observations)

    schema = "vec_id long, embedding array<float>, label int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", c.files_per_batch).parquet(c.observations)
    run = stream.writeStream.foreachBatch(keep).option("checkpointLocation", c.checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(taken), len(taken)


def screen(spark: SparkSession, c: Config) -> DataFrame:
    """Evidence and class of each target and driver, from all parts."""
    parts = spark.read.schema(PART).parquet(f"{c.out}/moments")
    return E.classify(E.evidence_of(E.merged_moments(parts, [*E.KEYS, "domain"])), c.evidence)


def screened(spark: SparkSession, out: str) -> DataFrame:
    """What the last run has written."""
    return spark.read.schema(SCREEN).parquet(f"{out}/screen")


def run(spark: SparkSession, c: Config) -> dict[str, int]:
    """Takes what is new and writes ``out/screen``, partitioned by target; returns the rows read and written."""
    read, batches = take_new(spark, c)
    out = f"{c.out}/screen"
    try:
        found = screen(spark, c)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log.info("no observations so far in %s", c.observations)
        return {"read": 0, "batches": 0, "written": 0}
    rows = found.select(*[x.split()[0] for x in SCREEN.split(", ")]).repartition("gene")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gene").parquet(out)
    done = {"read": read, "batches": batches, "written": screened(spark, c.out).count()}
    log.info("read %(read)d new observations in %(batches)d batches, wrote %(written)d pairs to " + out.replace("%", "%%"), done)
    return done


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config", required=True, help="YAML or JSON file of settings")
    for name in ("observations", "out", "checkpoint"):
        parser.add_argument(f"--{name}", help=f"instead of the file's {name}")
    given = vars(parser.parse_args(args))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("observation_stream").getOrCreate()
    try:
        run(spark, read_config(spark, given.pop("config"), Config, given))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
