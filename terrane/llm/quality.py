"""Host-level quality rules.

Every document is measured by fixed rules. Failures are then added up by host, each host's rate is
shrunk by a beta prior fitted to all hosts (method of moments), and the host's verdict is joined
back: documents of a host that surely fails more often than the corpus as a whole must pass the soft
rules too; elsewhere only the base rules reject. A third of all rows may belong to one host: sums are formed on the map side, and
the join back is left to adaptive execution, which splits a hot host's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import SPACE, bounded, split_words
from terrane.operators.lineage import cut

SHINGLE = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Soft rules: symbols per 100 words, repeated lines per 100 words, mean word length.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_CHARS = 10, 5, (2, 15)
#: A host is strict when the posterior mean less Z posterior deviations exceeds the pooled rate.
Z = 2.0
MAX_STRENGTH, MIN_VARIANCE = 1000.0, 1e-6


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """id, host and the measures of each document; see ``host_quality``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    start = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).alias("host"), split_words(text, SPACE).alias("w"), lines.alias("lines"),
        sum(((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))) for c in SYMBOLS), F.lit(0)).alias("n_symbols"),
    )
    counted = start.select(
        "id", "host", "n_symbols", F.size("w").alias("n_words"), F.char_length(F.array_join("w", "")).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    gram = ", ".join(f"h[i+{j}]" for j in range(SHINGLE))
    grams = counted.withColumn("g", F.expr(f"if(size(h) >= {SHINGLE}, transform(sequence(0, size(h)-{SHINGLE}), i -> xxhash64({gram})), cast(array() as array<bigint>))")).drop("h")
    # Most texts repeat no window: only the others sort their windows.
    ordered = grams.withColumn("o", F.expr("if(size(array_distinct(g)) < size(g), sort_array(transform(g, (x, i) -> struct(x as x, i as i))), null)")).drop("g")
    places = ordered.withColumn("q", F.expr(
        "sort_array(transform(filter(sequence(0, size(o)-1), j -> coalesce(get(o, j-1).x = o[j].x, false) or coalesce(get(o, j+1).x = o[j].x, false)), j -> o[j].i))"
    )).drop("o")
    repeat = F.expr(
        f"if(q is null, 0, {SHINGLE} + aggregate(sequence(0, size(q)-2), 0, (a, i) -> a + least({SHINGLE}, q[i+1] - q[i])))"
    )
    return places.withColumn("n_repeat_words", repeat).drop("q").select(
        "id", "host", *[F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    )


def base_failed() -> Column:
    """Too short, or too many words in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def soft_failed() -> Column:
    """Too many symbols or repeated lines, or words of an odd mean length."""
    n = F.col("n_words")
    odd = (F.col("word_chars") < WORD_CHARS[0] * n) | (F.col("word_chars") > WORD_CHARS[1] * n)
    return (100 * F.col("n_symbols") > MAX_SYMBOLS * n) | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * n) | odd


def host_verdicts(measured: DataFrame) -> DataFrame:
    """host, docs n, failures f, shrunk rate, strict: one row per host; null is a host of its own.

    The prior has the pooled rate as its mean; its strength follows from the spread of host rates
    beyond what chance gives. With one host, or no spread, the strength is at its maximum.
    """
    hosts = cut(measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum((base_failed() | soft_failed()).cast("long")).alias("f")
    ))
    # The prior is two sums over the hosts: two rows that reach the driver, and go back as constants.
    n_all, f_all, k = hosts.agg(F.sum("n"), F.sum("f"), F.count(F.lit(1))).first()
    if not k:
        return hosts.select("host", "n", "f", F.lit(0.0).alias("rate"), F.lit(False).alias("strict"))
    mean = f_all / n_all
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("f") / F.col("n") - F.lit(mean), F.lit(2.0)))).first()[0] / n_all
    extra = max(spread - mean * (1 - mean) * k / n_all, MIN_VARIANCE)
    strength = min(MAX_STRENGTH, max(1.0, mean * (1 - mean) / extra - 1))
    return (
        hosts.withColumn("rate", (F.lit(mean * strength) + F.col("f")) / (F.lit(strength) + F.col("n")))
        .withColumn("strict", F.col("rate") - Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.lit(strength) + F.col("n") + 1)) > F.lit(mean))
        .select("host", "n", "f", "rate", "strict")
    )


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: id_col, host, measures (long), base_failed, soft_failed, host_rate, strict, kept.

    word_chars: code points in words; n_symbols: characters of ``SYMBOLS``; n_dup_lines: lines with a
    word that equal an earlier line; n_repeat_words: words in 5-word windows found twice or more in
    the text. A null or empty text has no words and so fails the base rules. A null host is a host of
    its own. Repeated rows count and are returned each; other columns are left out, so none can clash.
    An empty table gives no rows.
    """
    measured = cut(measure(docs, id_col, text_col, host_col))
    verdict = bounded(cut(host_verdicts(measured))).select(F.col("host").alias("_host"), "rate", "strict")
    joined = measured.join(verdict, measured["host"].eqNullSafe(verdict["_host"]), "left")
    failed = joined.withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failed())
    return failed.select(
        F.col("id").alias(id_col), F.col("host"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed",
        F.col("rate").alias("host_rate"), "strict", (~F.col("base_failed") & ~(F.col("strict") & F.col("soft_failed"))).alias("kept"),
    )
