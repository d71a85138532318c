"""Iterative masks: mixtures, random walks, contours, clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.lineage import cut

#: Distinct values whose rounds of EM go over an array of counts; rounds over more values are Spark's aggregates.
ARRAY_VALUES = 200_000


def _em_sums(rows: DataFrame, mean: float, array_values: int):
    """A function of (mu, sd, w) that gives each component's share of rows, and its sums of distances and their squares."""
    held = rows.limit(array_values + 1).toPandas()
    if len(held) <= array_values:
        x, n = held["x"].to_numpy(float) - mean, held["n"].to_numpy(float)

        def local(mu, sd, w):
            p = w[:, None] / sd[:, None] * np.exp(-0.5 * ((x - mu[:, None]) / sd[:, None]) ** 2)
            share = n * p / (p.sum(0) + 1e-300)
            return np.stack([share.sum(1), (share * x).sum(1), (share * x * x).sum(1)], axis=1)

        return local
    d = F.col("x") - mean

    def passed(mu, sd, w):
        p = [F.lit(float(w[k] / sd[k])) * F.exp(-0.5 * F.pow((d - float(mu[k])) / float(sd[k]), F.lit(2.0))) for k in (0, 1)]
        share = [F.col("n") * x / (p[0] + p[1] + 1e-300) for x in p]
        return np.array(rows.agg(*[F.sum(part * power) for part in share for power in (F.lit(1.0), d, d * d)]).first()).reshape(2, 3)

    return passed


def mixture(counts: DataFrame, rounds: int = 100, tolerance: float = 1e-9, array_values: int = ARRAY_VALUES) -> dict[str, float]:
    """Two Gaussians by EM from (value, n): weights, means and deviations, low and high.

    A round needs six sums over the values' counts; it is the last once no parameter moves by more than ``tolerance``
    of the spread. Values are taken from their mean, so that squares cost no digits.
    """
    rows = cut(counts.toDF("x", "n").select(F.col("x").cast("double").alias("x"), F.col("n").cast("double").alias("n")).where("x is not null and not isnan(x)"))
    total, mean, q25, q75 = rows.select(F.sum("n"), F.sum(F.col("x") * F.col("n")) / F.sum("n"), *[F.percentile("x", F.lit(q), F.col("n").cast("int")) for q in (0.25, 0.75)]).first()
    if not total:
        raise ValueError("there are no values to fit")
    d = F.col("x") - mean
    spread = float(np.sqrt(rows.agg(F.sum(F.col("n") * d * d)).first()[0] / total)) + 1e-4
    mu, sd, w = np.array([q25, q75]) - mean, np.array([spread, spread]), np.array([0.5, 0.5])
    sums = _em_sums(rows, mean, array_values)
    for _ in range(rounds):
        found = sums(mu, sd, w)
        weight = found[:, 0] + 1e-12
        new_mu = found[:, 1] / weight
        new_sd = np.sqrt(np.maximum(found[:, 2] / weight - new_mu**2, 0) + 1e-8)
        moved = max(np.abs(new_mu - mu).max(), np.abs(new_sd - sd).max()) / spread
        w, mu, sd = weight / total, new_mu, new_sd
        if moved < tolerance:
            break
    mu = mu + mean
    low, high = np.argsort(mu)
    return {f"{k}_{name}": float(v[i]) for name, i in (("low", low), ("high", high)) for k, v in (("mu", mu), ("sd", sd), ("w", w))}


def _rasters(grid: DataFrame, size: tuple[int, int], by: list[str], solve, out: str) -> DataFrame:
    """by, row, col, v and column ``out`` (double; null where ``solve`` gives NaN) of each raster.

    solve: from the values and whether there is a pixel, as arrays, to an array. A raster is bounded by its
    size and is worked on in one task; rasters are dealt over all tasks.
    """

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        v, there = np.zeros(size), np.zeros(size, bool)
        at = frame["row"].to_numpy(), frame["col"].to_numpy()
        v[at], there[at] = frame["v"], True
        return frame.assign(**{out: solve(v, there)[at]})

    kinds = ", ".join(f"`{c}` {grid.schema[c].dataType.simpleString()}" for c in [*by, "row", "col", "v"])
    rows = grid.where("v is not null and not isnan(v)").select(*by, "row", "col", "v")
    return rows.groupBy(*by).applyInPandas(work, f"{kinds}, {out} double").withColumn(out, F.nanvl(out, F.lit(None).cast("double")))


def _scaled(v: np.ndarray, there: np.ndarray) -> np.ndarray:
    low, high = v[there].min(), v[there].max()
    return np.where(there, (v - low) / max(high - low, 1e-8), 0.0)


def walk(v: np.ndarray, there: np.ndarray, bright: float, dark: float, beta: float, tolerance: float = 1e-10) -> np.ndarray:
    """Probability that a random walk on the pixels meets a bright seed before a dark one.

    Steps across a difference d of the scaled values weigh exp(-beta d^2). Seeds are fixed; the others' linear
    system is symmetric and positive, and solved by conjugate gradients. Pixels that no seed reaches get 0.
    """
    scaled = _scaled(v, there)
    one = there & (scaled >= np.quantile(scaled[there], bright))
    zero = there & (scaled <= np.quantile(scaled[there], dark)) & ~one
    free = there & ~one & ~zero
    right = np.exp(-beta * (scaled[:, 1:] - scaled[:, :-1]) ** 2) * (there[:, 1:] & there[:, :-1])
    down = np.exp(-beta * (scaled[1:] - scaled[:-1]) ** 2) * (there[1:] & there[:-1])

    def around(x):
        total = np.zeros_like(x)
        total[:, :-1] += right * x[:, 1:]
        total[:, 1:] += right * x[:, :-1]
        total[:-1] += down * x[1:]
        total[1:] += down * x[:-1]
        return total

    degree = np.maximum(around(np.ones(v.shape)), 1e-300)
    p = np.zeros(v.shape)
    left = np.where(free, around(one.astype(float)), 0.0)
    ready = left / degree
    step, size = ready.copy(), (left * ready).sum()
    target = tolerance**2 * max(size, 1e-300)
    for _ in range(20 * free.sum()):
        if size <= target:
            break
        pulled = np.where(free, degree * step - around(step), 0.0)
        length = size / (step * pulled).sum()
        p += length * step
        left -= length * pulled
        ready = left / degree
        size, before = (left * ready).sum(), size
        step = ready + size / before * step
    return np.where(one, 1.0, np.where(there, p, np.nan))


def random_walker(grid: DataFrame, size: tuple[int, int], bright: float = 0.95, dark: float = 0.55, beta: float = 25.0, least: float = 0.7, gate: float = 0.82, by: list[str] | None = None) -> DataFrame:
    """by, row, col, v, p of the pixels whose walks meet bright seeds first with ``least`` or more, and that are in the values' top part (``gate``)."""
    by = by or []

    def solve(v, there):
        p = walk(v, there, bright, dark, beta)
        return np.where(there & (p >= least) & (v >= np.quantile(v[there], gate)), p, np.nan)

    return _rasters(grid, size, by, solve, "p").where("p is not null")


def _square(mask: np.ndarray, every: bool) -> np.ndarray:
    """Dilation by a 3 by 3 square, or erosion (``every``); beyond the grid nothing is set."""
    padded = np.pad(mask, 1)
    shifted = [padded[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)]
    return np.logical_and.reduce(shifted) if every else np.logical_or.reduce(shifted)


def contour(v: np.ndarray, there: np.ndarray, seed: float, cap: float, edge: float, rounds: int) -> np.ndarray:
    """A mask grown from bright seeds over capped pixels with weak gradients, closed in each round, until it stands still."""
    slope = np.hypot(*np.gradient(np.where(there, v, 0.0)))
    capped = there & (v >= np.quantile(v[there], cap))
    weak = capped & (slope <= np.quantile(slope[there], edge))
    mask = there & (v >= np.quantile(v[there], seed))
    for _ in range(rounds):
        grown = mask | (_square(mask, every=False) & weak)
        if (grown == mask).all():
            break
        mask = _square(_square(grown, every=False), every=True) & capped
    return mask


def active_contour(grid: DataFrame, size: tuple[int, int], seed: float = 0.95, cap: float = 0.84, edge: float = 0.70, rounds: int = 20, by: list[str] | None = None) -> DataFrame:
    """by, row, col of each raster's ``contour``."""
    by = by or []
    solve = lambda v, there: np.where(contour(v, there, seed, cap, edge, rounds), 1.0, np.nan)
    return _rasters(grid, size, by, solve, "m").where("m is not null").select(*by, "row", "col")


def diffusion_clusters(smooth: DataFrame, weight: float = 0.55) -> DataFrame:
    """row, col of the cluster with the highest mean of a smoothed grid (three clusters of value and place)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    limits = smooth.agg(*[f(c).alias(f"{n}_{c}") for c in ("v", "row", "col") for n, f in (("lo", F.min), ("hi", F.max))])
    unit = lambda c: (F.col(c) - F.col(f"lo_{c}")) / F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1e-8))
    rows = smooth.crossJoin(F.broadcast(limits)).select("row", "col", "v", unit("v").alias("a"), (weight * unit("row")).alias("b"), (weight * unit("col")).alias("c"))
    placed = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)
    labelled = KMeans(k=3, seed=7, maxIter=40).fit(placed).transform(placed).select("row", "col", "v", "prediction")
    best = labelled.groupBy("prediction").agg(F.avg("v").alias("m")).orderBy(F.desc("m")).limit(1).select("prediction")
    return labelled.join(F.broadcast(best), "prediction", "left_semi").select("row", "col")
