"""The corpus pipeline: documents to a mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import atexit
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontaminate, lines, mixing, simhash, toxicity
from terrane.llm.text import computed_once, table
from terrane.operators.lineage import checkpoint_folder, discard


def _once(found: DataFrame, out: str) -> DataFrame:
    """``found`` with its column ``out`` computed once, though filters and columns above use parts of it."""
    return found.select(*[F.col(f"`{c}`") for c in found.columns if c != out], computed_once(F.col(out)).alias(out))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go; it is trained on ``labels``."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of near-equal lines stays; documents that lose all their lines go."""
    found = _once(lines.dedup_lines(docs, out="_dedup"), "_dedup")
    kept = found.where("_dedup.n_removed = 0 or _dedup.n_removed < _dedup.n_lines")
    changed = F.col("_dedup.n_removed") > 0
    values = {"text": F.col("_dedup.text"), "n_chars": F.when(changed, F.char_length("_dedup.text").cast("long")).otherwise(F.col("n_chars"))}
    return kept.select(*[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows over at least a twentieth of their words go."""
    found = _once(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), out="_found"), "_found")
    return found.where(~decontaminate.contaminated(F.col("_found.n_hit"), F.col("_found.n_words"))).drop("_found")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how many words of each remaining document are taken (0: not taken)."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL has no factorization machine, XXH64 fingerprint or knapsack; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to ``documents``; each stage's rows are stored in the shared checkpoint folder.

    A stage's folder goes when the next one's is written; the last one's, which the result reads, at the end of the program.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    atexit.register(discard, spark, base)
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            discard(spark, before)
        before = f"{base}/{name}"
    return docs
