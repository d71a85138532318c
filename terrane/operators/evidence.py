"""Which drivers track a target everywhere, and which in one domain only.

From pairs (gene, enh, domain, x, y): correlations per domain and overall come from one grouping by
domain; overall moments are put together from the domains' (means and central co-moments, so that large
values or counts cost no digits): the long table is shuffled once and pre-aggregated before that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.numeric import entropy, pick, r, with_q_values


@dataclass(frozen=True)
class Thresholds:
    """Of the classes of evidence."""

    core: float = 0.35
    local: float = 0.20
    evidence: float = 0.005
    q: float = 0.10
    top_k: int = 5


KEYS = ["gene", "enh"]
#: Cells of a block of a torus; numbers that its shifts are laid over at once; groups whose means, or rows of a torus whose blocks, are broadcast.
BLOCK_CELLS, AT_ONCE, MEANS = 1 << 17, 1 << 20, 100_000


def domain_moments(pairs: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """n, means mx and my, and central sums cxx, cyy and cxy, by group and domain."""
    n = F.count(F.lit(1))
    return pairs.groupBy(*by, "domain").agg(
        n.alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") * n).alias("cxx"), (F.var_pop("y") * n).alias("cyy"), (F.covar_pop("x", "y") * n).alias("cxy")
    )


def overall_moments(moments: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """The moments of all domains of a group together; a group has one row a domain."""
    whole = moments.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("mx"), (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("my"),
        F.collect_list(F.struct("n", "mx", "my", "cxx", "cyy", "cxy")).alias("parts"),
    )
    add = lambda own, a, b: F.expr(f"aggregate(parts, 0D, (s, p) -> s + p.{own} + p.n * (p.{a} - {a}) * (p.{b} - {b}))").alias(own)
    return whole.select(*by, "n", "mx", "my", add("cxx", "mx", "mx"), add("cyy", "my", "my"), add("cxy", "mx", "my"))


def from_moments(policy: str = "zero") -> Column:
    """Pearson's r; 0 where it isn't defined."""
    spread = F.sqrt(F.greatest("cxx", F.lit(0.0)) * F.greatest("cyy", F.lit(0.0)))
    # Rounding leaves errors: a constant column counts as such from 1e-9.
    good = spread > (1e-9 if policy == "zero" else 1e-8)
    if policy == "zero_std":
        good = good & (F.col("n") >= 8)
    return F.when(good, F.col("cxy") / spread).otherwise(0.0)


def merged_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """Moments of groups of which ``parts`` has several rows, as from runs over parts of the data.

    Sums around the common mean: the parts' own, and what their means lie apart.
    """
    group = Window.partitionBy(*by)
    mean = lambda c: F.sum(F.col("n") * F.col(c)).over(group) / F.sum("n").over(group)
    apart = parts.withColumn("_x", mean("mx")).withColumn("_y", mean("my")).withColumn("_dx", F.col("mx") - F.col("_x")).withColumn("_dy", F.col("my") - F.col("_y"))
    whole = lambda own, a, b: F.sum(F.col(own) + F.col("n") * F.col(a) * F.col(b)).alias(own)
    return apart.groupBy(*by).agg(F.sum("n").alias("n"), F.first("_x").alias("mx"), F.first("_y").alias("my"), whole("cxx", "_dx", "_dx"), whole("cyy", "_dy", "_dy"), whole("cxy", "_dx", "_dy"))


def evidence(pairs: DataFrame, by: list[str] = KEYS, policy: str = "zero") -> DataFrame:
    """Per group: global and best regional correlation, its domain, advantage, specificity and evidence score."""
    return evidence_of(domain_moments(pairs, by), by, policy)


def evidence_of(moments: DataFrame, by: list[str] = KEYS, policy: str = "zero") -> DataFrame:
    """The same from moments by group and domain."""
    local = moments.select(*by, "domain", "n", r(from_moments(policy)).alias("local"))
    overall = overall_moments(moments, by).select(*by, r(from_moments(policy)).alias("global_concordance"))
    ranked = local.withColumn("place", pick([F.col("local").desc(), F.col("domain")], by))
    best = ranked.groupBy(*by).agg(
        F.max(F.when(F.col("place") == 1, F.col("local"))).alias("max_regional_concordance"), F.max(F.when(F.col("place") == 1, F.col("domain"))).alias("best_domain"),
        F.max(F.when(F.col("place") == 1, F.col("n"))).alias("best_domain_size"), F.coalesce(F.percentile(F.when(F.col("place") > 1, F.col("local")), F.lit(0.5)), F.lit(0.0)).alias("median_other"),
    )
    joined = best.join(overall, by).withColumn("local_advantage", r(F.col("max_regional_concordance") - F.col("global_concordance"))).withColumn(
        "regional_specificity", r(F.col("max_regional_concordance") - F.col("median_other"))
    )
    zero = F.lit(0.0)
    score = F.greatest("max_regional_concordance", zero) * F.greatest("local_advantage", zero) * F.greatest("regional_specificity", zero)
    return joined.withColumn("regional_evidence_score", r(score)).drop("median_other")


def classify(found: DataFrame, t: Thresholds = Thresholds(), with_q: bool = False) -> DataFrame:
    """predicted_class: core, regional candidate or unsupported."""
    regional = (F.col("max_regional_concordance") >= t.local) & (F.col("regional_evidence_score") >= t.evidence)
    if with_q:
        regional = regional & (F.col("permutation_qvalue") <= t.q)
    return found.withColumn("predicted_class", F.when(F.col("global_concordance") >= t.core, "core_concordant").when(regional, "regional_candidate").otherwise("unsupported"))


def gene_complexity(classed: DataFrame, by: list[str], top_k: int = 5) -> DataFrame:
    """Per gene: counts by class, the top k regional evidence, the diversity of its domains, and their product's score."""
    is_regional = F.col("predicted_class") == "regional_candidate"
    placed = classed.withColumn("place", F.when(is_regional, pick([is_regional.desc(), F.col("regional_evidence_score").desc(), F.col("enh")], by)))
    top = placed.where(F.col("place") <= top_k).groupBy(*by, "best_domain").agg(F.count(F.lit(1)).alias("k"), F.sum("regional_evidence_score").alias("s"))
    diverse = top.groupBy(*by).agg(r(F.sum("s")).alias("regional_evidence_topk_sum"), r(entropy("k")).alias("domain_diversity"))
    counts = classed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_enhancers"), F.count_if(F.col("predicted_class") == "core_concordant").alias("n_core"), F.count_if(is_regional).alias("n_regional_candidates"),
        F.count_if(F.col("predicted_class") == "unsupported").alias("n_unsupported"), F.countDistinct(F.when(is_regional, F.col("best_domain"))).alias("n_supported_domains"),
    )
    full = counts.join(diverse, by, "left").fillna(0.0, ["regional_evidence_topk_sum", "domain_diversity"])
    return full.withColumn("complexity_score", r(F.col("regional_evidence_topk_sum") * F.log1p(F.col("n_regional_candidates")) * (1 + F.col("domain_diversity"))))


def ranked(frame: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Sequential rank over all rows; for frames of one row a gene."""
    return frame.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def permutation_p(observed: DataFrame, null: DataFrame, by: list[str], n: int) -> DataFrame:
    """(1 + nulls at or above the observed) / (n + 1), then q-values within genes."""
    hits = observed.join(null, by).groupBy(*by).agg(F.count_if(F.col("null_max") >= F.col("max_regional_concordance")).alias("k"))
    p = observed.join(hits, by, "left").withColumn("permutation_pvalue", (1 + F.coalesce("k", F.lit(0))) / F.lit(float(n + 1))).drop("k")
    return with_q_values(p, "permutation_pvalue", [by[0]], "permutation_qvalue").withColumn("permutation_qvalue", r("permutation_qvalue"))


def toroidal_null(pixels: DataFrame, shifts: list[tuple[int, int]], rows: int, cols: int, by: list[str] = KEYS, cells: int = BLOCK_CELLS) -> DataFrame:
    """Per group and shift (perm: its place in ``shifts``, as (dy, dx)): the largest domain correlation after x is rolled around the grid.

    pixels: by, row, col, domain, x, y; cells without a pixel count in neither. The grid is cut into blocks of rows, of
    about ``cells`` cells; a block gets its own pixels and those that a shift rolls into it, so a task holds one block
    of one group. Shifts are laid over it a few at a time in NumPy, as sums by domain are products with the domains'
    indicators, and the blocks' sums are added up.
    """
    height = max(1, min(rows, cells // cols))
    last = (rows - 1) // height
    dys = sorted({dy % rows for dy, _ in shifts})
    at = np.arange(cols)

    # The blocks that a row's pixels belong to or are rolled into, made once a row of the grid.
    to = F.transform(F.array(*[F.lit(d) for d in (0, *dys)]), lambda d: F.floor(((F.col("row") + d) % rows) / height).cast("int"))
    visited = pixels.sparkSession.range(rows).select(F.col("id").cast("int").alias("row"), F.array_distinct(to).alias("_blocks"))
    # Centred by the group, so that sums of squares cost no digits and blocks' sums can be added.
    means = pixels.groupBy(*by).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    spread = pixels.withColumn("_block", F.lit(0)) if last == 0 else pixels.join(F.broadcast(visited) if rows <= MEANS else visited, "row").withColumn("_block", F.explode("_blocks"))
    names = [*by, "_block", "row", "col", "domain", "x", "y"]
    centred = spread.join(F.broadcast(means) if len(means.head(MEANS + 1)) <= MEANS else means, by).select(*names[:-2], (F.col("x") - F.col("_mx")).alias("x"), (F.col("y") - F.col("_my")).alias("y"))
    out = [*by, "perm", "domain", "n", "sx", "sy", "sxx", "syy", "sxy"]

    def sums(frame):
        row, col, domain, x, y = (frame[c].to_numpy() for c in ("row", "col", "domain", "x", "y"))
        home = row // height == frame["_block"].iloc[0]
        if not home.any():
            return pd.DataFrame({c: [] for c in out})
        present, place = np.unique(row, return_inverse=True)
        # A row of nothing comes last, for rows that no pixel has.
        xs = np.full((len(present) + 1, cols), np.nan)
        xs[place, col] = x
        own, place = np.unique(row[home], return_inverse=True)
        kind, still = np.full((len(own), cols), -1), np.full((len(own), cols), np.nan)
        kind[place, col[home]], still[place, col[home]] = domain[home], y[home]
        kinds, kind, still = np.unique(domain[home]), kind.ravel(), still.ravel()
        of = (kind[:, None] == kinds[None, :]).astype(float)
        found = []
        step = max(1, AT_ONCE // len(still))
        for lo in range(0, len(shifts), step):
            rolled = []
            for dy, dx in shifts[lo : lo + step]:
                want = (own - dy) % rows
                i = np.searchsorted(present, want)
                i[present[np.minimum(i, len(present) - 1)] != want] = len(present)
                rolled.append(xs[i][:, (at - dx) % cols].ravel())
            moved = np.stack(rolled)
            there = np.isfinite(moved) & np.isfinite(still)
            a, b = np.where(there, moved, 0.0), np.where(there, still, 0.0)
            found.append(np.stack([m @ of for m in (there.astype(float), a, b, a * a, b * b, a * b)], axis=-1))
        values = np.concatenate(found).reshape(-1, 6) if found else np.zeros((0, 6))
        perm = np.arange(len(values)) // len(kinds)
        return pd.DataFrame({**{c: frame[c].iloc[0] for c in by}, "perm": perm, "domain": np.tile(kinds, len(shifts)), "n": values[:, 0].astype(np.int64), **{c: values[:, k] for k, c in enumerate(out[-5:], 1)}}, columns=out)

    kinds = ", ".join(f"`{c}` {pixels.schema[c].dataType.simpleString()}" for c in by)
    parts = centred.groupBy(*by, "_block").applyInPandas(sums, f"{kinds}, perm int, domain int, n long, sx double, sy double, sxx double, syy double, sxy double")
    whole = parts.groupBy(*by, "perm", "domain").agg(*[F.sum(c).alias(c) for c in out[-6:]])
    minus = lambda a, b: F.expr(f"case when n > 0 then s{a}{b} - s{a} * s{b} / n else 0 end").alias(f"c{a}{b}")
    central = whole.select(*by, "perm", "n", minus("x", "x"), minus("y", "y"), minus("x", "y"))
    return central.groupBy(*by, "perm").agg(F.max(r(from_moments("zero_std"))).alias("null_max"))


def elbow(scores: DataFrame, rank: str, score: str) -> DataFrame:
    """One row: the rank at which the falling curve of log10 scores is farthest below its chord."""
    positive = scores.where(F.col(score) > 0).select(F.col(rank).alias("k"), F.log10(F.col(score) + 1e-6).alias("t"))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = positive.select(
        "k", "t", F.row_number().over(Window.orderBy("k")).alias("i"), F.count(F.lit(1)).over(w).alias("n"), F.first("t").over(w).alias("top"), F.last("t").over(w).alias("end")
    )
    gap = (1 - (F.col("i") - 1) / F.greatest(F.col("n") - 1, F.lit(1))) - (F.col("t") - F.col("end")) / F.greatest(F.col("top") - F.col("end"), F.lit(1e-12))
    best = placed.withColumn("gap", r(gap, 9)).agg(F.max("n").alias("n"), F.max_by("i", F.struct(F.col("gap"), -F.col("i"))).alias("i"))
    return best.select(F.when(F.coalesce("n", F.lit(0)) < 3, F.coalesce("n", F.lit(0))).otherwise(F.col("i")).cast("long").alias("elbow"))
