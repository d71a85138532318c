"""Sketches that are kept by part and merged again: distinct values, quantiles, frequent values.

All are Spark's own aggregates, which combine on the map side; a sketch's size depends on its precision only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the distinct sketch's registers (a relative error of about 0.8 % each); the quantile sketch's k (about 1 % of
#: rank); values that the frequency sketch keeps track of (counts are off by 3.5 rows / this at most).
DISTINCT_BITS, QUANTILE_K, TRACKED = 14, 400, 4096
QUANTILES, TOP = (0.5, 0.9, 0.99), 5


def sketch(rows: DataFrame, by: list[str], key: str, value: str, tracked: int = TRACKED) -> DataFrame:
    """by, n, and sketches of the distinct and frequent values of ``key`` and of the quantiles of ``value``; nulls count in n only.

    Parts of which a sketch has nothing to say (all null) have none.
    """
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(key), F.lit(DISTINCT_BITS)).alias("distinct"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_K)).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate(`{key}`, {tracked}) filter (where `{key}` is not null)").alias("frequent"),
    )


def merge(parts: DataFrame, by: list[str], quantiles: tuple[float, ...] = QUANTILES, top: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """by, n, distinct, quantiles (array), frequent (array of item and count, most frequent first) of kept sketches together."""
    merged = parts.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("d"), F.kll_merge_agg_double("quantiles").alias("q"), F.expr(f"approx_top_k_combine(frequent, {tracked})").alias("f"),
    )
    at = F.array(*[F.lit(float(x)) for x in quantiles])
    return merged.select(*by, "n", F.hll_sketch_estimate("d").alias("distinct"), F.kll_sketch_get_quantile_double("q", at).alias("quantiles"), F.expr(f"approx_top_k_estimate(f, {top})").alias("frequent"))
