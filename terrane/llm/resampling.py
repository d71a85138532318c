"""Importance resampling: draws the documents that look most like a target corpus.

Features are hashed into buckets. A bucket's gain is the log ratio of its share in the target and in the
documents, in thousandths; a document's weight is the mean gain of its features, looked up in one array.
Weights get Gumbel noise from the document's id, so the highest scores are a draw without replacement by
weight. Scores are integers: their exact histogram, summed from the top, tells each score's rank offset
and the cutoff, and only documents at or above the cutoff are numbered, score by score.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.llm.text import bounded, computed_once, lower_ascii, split_words
from terrane.operators.lineage import cut, store

BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 25, 20, 7
#: Scores of a histogram block: offsets are summed within blocks, then over the blocks.
BLOCK = 512


def buckets_of(words: str, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and pairs of consecutive words (SQL name of an array of words), repeats included."""
    pairs = f"zip_with(slice({words}, 1, greatest(size({words}) - 1, 0)), slice({words}, 2, greatest(size({words}) - 1, 0)), (a, b) -> cast(crc32(concat(a, ' ', b)) % {buckets} as int))"
    return F.expr(f"concat(transform({words}, a -> cast(crc32(a) % {buckets} as int)), {pairs})")


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket: pre-aggregated in each task, one number a bucket in the driver."""
    words = texts.select(computed_once(split_words(lower_ascii(F.col(f"`{text_col}`")))).alias("w"))
    found = np.zeros(buckets, dtype=np.int64)
    for row in words.select(F.explode(buckets_of("w", buckets)).alias("b")).groupBy("b").count().collect():
        found[row.b] = row["count"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, by bucket."""
    n, s, t = len(source), source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of seed and id (null: as an empty id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def rank_offsets(scores: DataFrame) -> DataFrame:
    """score, n, above: for rows of a column score, how many have each score, and how many a higher one.

    A score is a mean gain plus noise, both within some ten thousand thousandths of zero, so the histogram
    has some ten thousand rows whatever the number of documents; it is summed by blocks all the same.
    """
    counted = cut(scores.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("score") / BLOCK)))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("over"))
    within = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return cut(counted.select("score", "n", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("own")).join(F.broadcast(blocks), "block").select("score", "n", (F.col("own") + F.col("over")).alias("above")))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), target_text: str = "text",
    percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """Per document: id_col, the carried columns, n_features, weight, score, rank (1 is the highest; null if not drawn).

    Of the N documents of at least ``min_words`` words, floor(percent * N / 100) are drawn: the highest
    scores, ties to the smaller id (null ids last), then to fewer features. Null and empty texts have no features and
    weight 0, and are never drawn. Rows that repeat an id have the same noise and are ranked each; rows equal
    in all that is returned are interchangeable. An empty table gives no rows; with an empty target all
    gains follow from smoothing alone. Other columns are left out, so their names don't matter; a carried
    column may not have the name of a result.
    """
    if taken := {c.lower() for c in carry} & {"n_features", "weight", "score", "rank", id_col.lower()}:
        raise ValueError(f"results have these names already: {sorted(taken)}")
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text, buckets))
    looked_up = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")
    kept = [F.col(f"`{c}`") for c in (id_col, *carry)]
    words = docs.select(*kept, computed_once(split_words(lower_ascii(F.col(f"`{text_col}`")))).alias("_w"))
    hashed = words.select(*kept, F.size("_w").alias("_n"), buckets_of("_w", buckets).alias("_b"))
    total = F.aggregate("_b", F.lit(0).cast("long"), lambda a, b: a + F.get(looked_up, b))
    summed = hashed.select(*kept, "_n", F.size("_b").cast("long").alias("n_features"), total.alias("_t"))
    weight = F.expr("case when n_features = 0 then 0L else (_t - pmod(_t, n_features)) div n_features end")
    scored = store(summed.select(*kept, (F.col("_n") >= min_words).alias("_fit"), "n_features", weight.alias("weight"), (weight + noise(F.col(f"`{id_col}`"), seed)).alias("score")))
    offsets = rank_offsets(scored.where("_fit").select("score"))
    eligible = offsets.agg(F.sum("n")).first()[0] or 0
    drawn = percent * eligible // 100
    cutoff = offsets.where(F.col("above") < drawn).agg(F.min("score")).first()[0]
    result = [*kept, "n_features", "weight", "score"]
    never = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return scored.select(*result, never)
    surviving = scored.where(F.col("_fit") & (F.col("score") >= cutoff)).join(bounded(offsets.where(F.col("score") >= cutoff).select("score", "above")), "score")
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last(F.col(f"`{id_col}`")), "n_features", "weight")
    rank = F.col("above") + F.row_number().over(order)
    ranked = surviving.select(*result, rank.alias("_r")).select(*result, F.when(F.col("_r") <= drawn, F.col("_r")).alias("rank"))
    return ranked.unionByName(scored.where(~F.col("_fit") | (F.col("score") < cutoff)).select(*result, never))
