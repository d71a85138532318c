"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

import atexit
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontaminate, html, licenses, lines, mixing, quality, resampling, simhash, tokens, toxicity, urls, warc
from terrane.llm.oracles import ORACLES
from terrane.llm.text import table
from terrane.operators.lineage import checkpoint_folder, discard, store


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of benchmark contamination; a repeated document id is judged row by row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), out="c").select("doc_id", "c.*")
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    got = simhash.link_documents(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the quality rules; the host is the document's source."""
    got = quality.host_quality(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the model is trained on the labelled rows that aren't held out."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    got = html.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), out="text")
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the license scan."""
    got = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    first, last = F.array_min(F.transform("base", lambda x: x["first"])), F.array_max(F.transform("base", lambda x: x["first"]))
    return got.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts without their repeated and near-equal lines."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), out="d").select("doc_id", "d.*")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages' urls."""
    got = urls.filter_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark))
    return got.select("page_id", "host", "path", "rule", "verdict")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all pages' records, read from the archives that they were written to; an unsound record is an error."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/warc-{uuid4().hex}"
    atexit.register(discard, spark, path)
    pages = table(spark, sf_dir, "pages")
    if not pages.limit(1).count():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    warc.write_warc(pages, path)
    got = warc.resolve(store(warc.read_warc(spark, path, payloads=False)))
    sound = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", "path", "offset", "problem"))).otherwise(F.col("record_type"))
    return got.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of all documents; the target is the benchmark."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_simhash, op3_host_quality, op4_toxicity, op5_html_text, op6_token_counts, op7_licenses, op8_line_dedup, op9_url_filter, op10_mixing, op11_warc, op12_importance_resampling)}
