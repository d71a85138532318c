"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source whose target is q whole passes and a
remainder takes every document q times; the remainder is filled from the length counts: every length
gives its proportional number of documents, the largest lengths that fit reduce what is left, and a
bounded knapsack over the counts still free finds the subset nearest to the rest. Which documents of
a length are taken is a seeded choice: the lowest hashes of their ids. Only length counts reach the
knapsack (one small group per source); a hot source or length is split by hash range, so that no
task ranks a whole group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.llm.text import SPACE, bounded, split_words
from terrane.operators.lineage import cut

WEIGHTS, MAX_PASSES, SEED = (1, 2, 3), 3, 17
#: Words of a budget times parts (a length's counts are split into powers of two) that a knapsack goes through.
#: Up to this the whole budget is fitted exactly; beyond, what proportional counts leave of it, this many over the parts.
WORK = 500_000_000
#: Documents that share source and length are ranked in hash ranges of about this many.
RANK_ROWS = 2000


def source_targets(per_source: DataFrame) -> DataFrame:
    """source, source_size -> also weight and target (double).

    Sources in code point order, null last, weigh 1, 2, 3 and so on again. Targets share the sum of
    sizes by weight; a target stops at MAX_PASSES times its source's size and the excess is shared by
    weight among the rest until none is above: target = min(cap, level * weight) at the level where
    targets add up to the sum. One row per source goes through one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    caps = per_source.withColumn("weight", weights).withColumn("cap", F.col("source_size").cast("double") * MAX_PASSES)
    # In order of cap per weight, sources stay capped as long as the level that the others share is above it.
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_first())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    here_on = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(here_on)
    levels = caps.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    levels = levels.withColumn("place", F.row_number().over(by_ratio))
    first = F.min(F.when(F.col("free"), F.struct("place", "level"))).over(Window.partitionBy())["level"]
    return levels.withColumn("target", F.coalesce(F.least(F.col("cap"), first * F.col("weight")), F.col("cap"))).select("source", "source_size", "weight", "target")


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, work: int = WORK) -> np.ndarray:
    """Documents to take of each size, at most ``counts``, so that their sizes sum to or nearly to ``budget``.

    The sum never exceeds the budget, and is the largest such sum if budget times parts is at most ``work``: for 50
    documents up to ten million words, of any lengths. Larger budgets take proportional counts first, then the
    largest documents that fit, until the rest is that small. Sizes are positive, distinct and ascending.
    """
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.astype(np.int64).copy()
    exact = work // int(sum(int(c).bit_length() for c in counts))
    left = budget
    if budget > exact:
        take = np.minimum(np.floor(counts * max(0.0, (budget - exact // 2) / total)), counts).astype(np.int64)
        left = budget - int((sizes * take).sum())
        for i in range(len(sizes) - 1, -1, -1):
            if left <= exact:
                break
            more = min(int(counts[i] - take[i]), (left - exact // 2) // int(sizes[i]))
            if more > 0:
                take[i] += more
                left -= more * int(sizes[i])
    # Bounded knapsack over the counts still free, split into powers of two: by is the part that first reached a sum.
    cap, free_counts = min(left, max(exact, 1)), counts - take
    reached, by, parts = np.zeros(cap + 1, bool), np.full(cap + 1, -1, np.int32), []
    reached[0] = True
    for i in range(len(sizes) - 1, -1, -1):
        s = int(sizes[i])
        free, k = min(int(free_counts[i]), cap // s), 1
        while free > 0 and not reached[cap]:
            n = min(k, free)
            new = np.nonzero(reached[: cap + 1 - n * s] & ~reached[n * s :])[0] + n * s
            reached[new], by[new] = True, len(parts)
            parts.append((i, n))
            free, k = free - n, 2 * k
    rest = int(np.nonzero(reached)[0][-1])
    while rest:
        i, n = parts[by[rest]]
        take[i] += n
        rest -= n * int(sizes[i])
    return take


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    """Passes and further documents of each length of one source."""
    rows = rows.sort_values("size", kind="stable").reset_index(drop=True)
    source_size, target = int(rows.source_size[0]), float(rows.target[0])
    passes = min(MAX_PASSES, int(target // source_size)) if source_size else 0
    budget = int(np.floor(target - passes * source_size + 0.5)) if passes < MAX_PASSES else 0
    live = (rows["size"] > 0).to_numpy()
    extra = np.zeros(len(rows), np.int64)
    extra[live] = fit_budget(rows["size"].to_numpy()[live], rows["docs"].to_numpy()[live], budget)
    return rows.assign(passes=passes, extra=extra)[["source", "size", "docs", "source_size", "target", "passes", "extra"]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """Per document: id_col, source, size, source_size, target, copies, taken (copies times size).

    A null or empty text has size 0 and is taken 0 times; a null source is a source of its own, last in
    order. Rows that share an id are documents each; equal rows tie in the seeded order and any of them
    may be taken. Other columns are left out, so none can clash. An empty table gives no rows.
    """
    size = F.size(split_words(F.col(text_col), SPACE)).cast("long")
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")))
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs"))
    counts = cut(counts)
    targets = source_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    lengths = counts.join(t, counts["source"].eqNullSafe(t["_s"])).drop("_s")
    schema = "source string, size long, docs long, source_size long, target double, passes int, extra long"
    plan = cut(lengths.select(F.col("source").cast("string"), "size", "docs", "source_size", "target").groupBy("source").applyInPandas(_plan, schema))
    p = bounded(plan).select(F.col("source").alias("_s"), F.col("size").alias("_size"), "docs", "source_size", "target", "passes", "extra")
    ranges = F.greatest(F.lit(1), (F.col("docs") / RANK_ROWS).cast("int"))
    hashed = F.xxhash64("id", F.lit(seed))
    joined = sized.join(p, sized["source"].eqNullSafe(p["_s"]) & (sized["size"] == p["_size"])).drop("_s", "_size").select(
        "*", hashed.alias("h"), F.when((F.col("extra") > 0) & (F.col("extra") < F.col("docs")), F.pmod(F.shiftrightunsigned(hashed, 33), ranges)).alias("range")
    )
    open_rows = joined.where("range is not null")
    groups = ["source", "size"]
    per_range = open_rows.groupBy(*groups, "range").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*groups).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        F.col("source").alias("_s"), F.col("size").alias("_size"), F.col("range").alias("_r"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset")
    )
    rank = F.row_number().over(Window.partitionBy(*groups, "range").orderBy("h", "id"))
    ranked = open_rows.withColumn("rank", rank)
    chosen = (
        ranked.join(offsets, ranked["source"].eqNullSafe(offsets["_s"]) & (ranked["size"] == offsets["_size"]) & (ranked["range"] == offsets["_r"]))
        .withColumn("more", (F.col("offset") + F.col("rank") <= F.col("extra")).cast("int"))
        .drop("_s", "_size", "_r", "offset", "rank")
    )
    plain = joined.where("range is null").withColumn("more", ((F.col("extra") > 0)).cast("int"))
    both = chosen.unionByName(plain).withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + F.col("more")))
    return both.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
