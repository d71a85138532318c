"""Which words go with a label in every language, and which in one language only.

The evidence screen over texts: documents are the observations, languages the domains, labels (such as
quality or toxic) the targets, and each word that enough labelled documents hold is a driver, present or
not. Only words that are there are counted: correlations follow from how many documents a language has,
how many have the label, the word, and both, so absences cost no rows.

Writes ``out/words`` (evidence and class of each word, partitioned by target) and ``out/targets`` (each
target's complexity, partitioned by target). Both are replaced partition by partition, so a rerun gives
the same rows, and targets that a run doesn't ask for stay.

    python -m jobs.word_screen --config jobs/word_screen.yaml
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import evidence as E
from terrane.operators.lineage import cut
from terrane.sources.config import read_config

log = logging.getLogger("jobs.word_screen")
#: What a row of ``out/words`` has; what separates words.
SCORES = "max_regional_concordance double, best_domain string, best_domain_size long, global_concordance double, local_advantage double, regional_specificity double, regional_evidence_score double, predicted_class string"
WORDS = f"word string, n_documents long, {SCORES}, target string"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Config:
    """Paths, the label columns to screen for, and the least number of labelled documents that hold a word."""

    documents: str
    labels: str
    out: str
    targets: tuple[str, ...] = ("quality", "toxic")
    min_documents: int = 20
    evidence: E.Thresholds = field(default_factory=E.Thresholds)


def labelled(documents: DataFrame, labels: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """gene (the target's name), domain, y, words (distinct, A-Z lower-cased): a row for each label of a document.

    Documents without labels and labels without documents are left out, as are null labels; a null language
    is a domain of its own, a null text has no words. A document with several label rows counts for each.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.coalesce("text", F.lit("")), upper, upper.lower())
    wanted = labels.select("doc_id", F.explode(F.array(*[F.struct(F.lit(t).alias("gene"), F.col(t).cast("double").alias("y")) for t in targets])).alias("l"))
    joined = documents.select("doc_id", F.coalesce("lang", F.lit("none")).alias("domain"), text.alias("text")).join(labels, "doc_id", "left_semi")
    words = joined.select("doc_id", "domain", F.array_remove(F.array_distinct(F.split("text", SEPARATOR)), "").alias("words"))
    return words.join(wanted.where("l.y is not null"), "doc_id").select("l.gene", "domain", "l.y", "words")


def domain_totals(rows: DataFrame) -> DataFrame:
    """gene, domain, n, ny, nyy: documents, their labels' sum and sum of squares; texts aren't read for this."""
    return rows.groupBy("gene", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ny"), F.sum(F.col("y") * F.col("y")).alias("nyy"))


def word_moments(rows: DataFrame, totals: DataFrame, min_documents: int) -> DataFrame:
    """gene, enh (the word), domain, n_documents and moments, for all domains of a target, whether they have the word or not.

    ``totals``: a row for each target and domain, few enough to go to every task. A word's presence is 1 or 0.
    """
    domains = totals.groupBy("gene").agg(F.collect_list(F.struct("domain", "n", "ny", "nyy")).alias("domains"))
    there = rows.select("gene", "domain", "y", F.explode("words").alias("enh")).groupBy("gene", "enh", "domain").agg(F.count(F.lit(1)).alias("nx"), F.sum("y").alias("nxy"))
    words = there.groupBy("gene", "enh").agg(F.sum("nx").alias("n_documents"), F.map_from_entries(F.collect_list(F.struct("domain", F.struct("nx", "nxy")))).alias("found"))
    spread = words.where(F.col("n_documents") >= min_documents).join(F.broadcast(domains), "gene").select("gene", "enh", "n_documents", "found", F.explode("domains").alias("d"))
    counts = spread.select("gene", "enh", "n_documents", "d.*", F.expr("coalesce(found[d.domain].nx, 0L)").alias("nx"), F.expr("coalesce(found[d.domain].nxy, 0D)").alias("nxy"))
    return counts.select(
        "gene", "enh", "n_documents", "domain", "n", F.expr("nx / n").alias("mx"), F.expr("ny / n").alias("my"),
        F.expr("nx - nx * nx / n").alias("cxx"), F.expr("nyy - ny * ny / n").alias("cyy"), F.expr("nxy - nx * ny / n").alias("cxy"),
    )


def words_of(spark: SparkSession, out: str) -> DataFrame:
    """What runs have written, of all targets."""
    return spark.read.schema(WORDS).parquet(f"{out}/words")


def run(spark: SparkSession, c: Config) -> dict[str, int]:
    """Screens all words and writes both tables; returns the rows read and written."""
    documents, labels = spark.read.parquet(c.documents), spark.read.parquet(c.labels)
    rows = labelled(documents, labels, c.targets)
    totals = cut(domain_totals(rows))
    moments = word_moments(rows, totals, c.min_documents)
    found = E.classify(E.evidence_of(moments, [*E.KEYS, "n_documents"]), c.evidence)
    words = found.withColumnsRenamed({"gene": "target", "enh": "word"}).select(*[x.split()[0] for x in WORDS.split(", ")])
    replace = lambda frame, name: frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target").parquet(f"{c.out}/{name}")
    replace(words, "words")
    kept = words_of(spark, c.out).where(F.col("target").isin(*c.targets))
    complexity = E.gene_complexity(kept.withColumnsRenamed({"target": "gene", "word": "enh"}), ["gene"], c.evidence.top_k).withColumnsRenamed({"gene": "target", "n_enhancers": "n_words"})
    replace(complexity, "targets")
    done = {"read": totals.agg(F.sum("n")).first()[0] or 0, "words": kept.count(), "targets": kept.select("target").distinct().count()}
    log.info("read %(read)d labels of documents, wrote %(words)d words and %(targets)d targets to " + c.out.replace("%", "%%"), done)
    return done


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config", required=True, help="YAML or JSON file of settings")
    for name in ("documents", "labels", "out"):
        parser.add_argument(f"--{name}", help=f"instead of the file's {name}")
    given = vars(parser.parse_args(args))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("word_screen").getOrCreate()
    try:
        run(spark, read_config(spark, given.pop("config"), Config, given))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
