"""k-means from many starts at once, and principal components of wide rows, both by passes over the rows in tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.lineage import cut

#: Rows from which starts are chosen.
SAMPLE = 20_000


def starts(sample: np.ndarray, k: int, n: int, seed: int) -> np.ndarray:
    """n sets of k centres (n, k, d), each chosen from the sample with odds by the squared distance to those chosen before."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        chosen = [sample[rng.integers(len(sample))]]
        d2 = ((sample - chosen[0]) ** 2).sum(axis=1)
        while len(chosen) < k:
            total = d2.sum()
            chosen.append(sample[rng.choice(len(sample), p=d2 / total) if total > 0 else rng.integers(len(sample))])
            d2 = np.minimum(d2, ((sample - chosen[-1]) ** 2).sum(axis=1))
        out.append(np.stack(chosen))
    return np.stack(out)


def assigned(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centre (the first of equally near) and its squared distance."""
    d2 = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
    own = d2.argmin(axis=1)
    return own, d2[np.arange(len(points)), own]


def kmeans(rows: DataFrame, axes: list[str], k: int, n_starts: int = 20, rounds: int = 100, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(centres of the best start, in order; costs of all starts): Lloyd's rounds for all starts in one pass each.

    Tasks send sums a start and cluster; a start whose centres stay is done. A cluster that loses all its points keeps
    its centre. ``rows`` without missing values; there must be some.
    """
    rows = cut(rows.select(*axes))
    n = rows.count()
    if not n:
        raise ValueError("there are no rows to cluster")
    sample = rows.sample(min(1.0, SAMPLE / n), 3).toPandas().to_numpy(float) if n > SAMPLE else rows.toPandas().to_numpy(float)
    centres = starts(sample[np.lexsort(sample.T)], k, n_starts, seed)
    costs, live = np.full(n_starts, np.inf), np.ones(n_starts, bool)
    for last in range(rounds + 1):
        now, asked = centres, np.nonzero(live)[0]

        def sums(frames, now=now, asked=asked):
            total = np.zeros((len(asked), k, 2 + len(axes)))
            for frame in frames:
                points = frame.to_numpy(float)
                for i, s in enumerate(asked):
                    own, d2 = assigned(points, now[s])
                    total[i, :, 0] += np.bincount(own, minlength=k)
                    total[i, :, 1] += np.bincount(own, d2, minlength=k)
                    for a in range(len(axes)):
                        total[i, :, 2 + a] += np.bincount(own, points[:, a], minlength=k)
            yield pd.DataFrame([(int(s), c, *total[i, c]) for i, s in enumerate(asked) for c in range(k)], columns=["start", "cluster", "n", "cost", *axes])

        schema = "start int, cluster int, n double, cost double, " + ", ".join(f"`{c}` double" for c in axes)
        found = rows.mapInPandas(sums, schema).groupBy("start", "cluster").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *axes)]).toPandas()
        centres, before = centres.copy(), centres
        costs[asked] = 0.0
        for r in found.itertuples(index=False):
            costs[r.start] += r.cost
            if r.n and last < rounds:
                centres[r.start, r.cluster] = np.array(r[4:]) / r.n
        live = (np.abs(centres - before) > 1e-12).any(axis=(1, 2))
        if not live.any():
            break
    best = centres[int(np.round(costs, 9).argmin())]
    return best[np.lexsort(best.T[::-1])], costs


def labelled(rows: DataFrame, axes: list[str], centres: np.ndarray, out: str) -> DataFrame:
    """``rows`` with the number of the nearest centre."""

    def label(frames):
        for frame in frames:
            yield frame.assign(**{out: assigned(frame[axes].to_numpy(float), centres)[0].astype(np.int32)})

    return rows.mapInPandas(label, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` int")


def components(rows: DataFrame, x: str, k: int, extra: int = 10, passes: int = 6, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, deviation, components, explained variances) of standardised rows of arrays: the first k, by block power iterations.

    Each pass multiplies all rows with a block of k + extra directions and back, so tasks hold matrices of columns by
    directions, and never of columns by columns. A column without spread stays 0. The largest entry of a component is positive.
    """
    stats = rows.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.count("v").alias("n")).toPandas().sort_values("i")
    mean, deviation, n = stats["m"].to_numpy(float), stats["s"].fillna(0.0).to_numpy(float), int(stats["n"].max())
    scale = np.where(deviation > 1e-12, 1 / np.where(deviation > 1e-12, deviation, 1.0), 0.0)
    p = len(mean)
    wide = min(p, k + extra)
    kept = cut(rows.select(F.col(x).cast("array<double>").alias("x")))

    def times(block: np.ndarray) -> np.ndarray:
        """The covariance's product with a block of directions."""

        def products(frames):
            total = np.zeros((p, wide))
            for frame in frames:
                z = (np.stack(frame["x"]) - mean) * scale if len(frame) else np.zeros((0, p))
                total += z.T @ (z @ block)
            yield pd.DataFrame({"i": np.arange(p), "v": list(total)})

        parts = kept.mapInPandas(products, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros((p, wide))
        out[parts["i"], parts["j"]] = parts["v"]
        return out / max(n - 1, 1)

    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, wide)))[0]
    for _ in range(passes):
        block = np.linalg.qr(times(block))[0]
    small = block.T @ times(block)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    found = (block @ vectors[:, order]).T
    found *= np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])[:, None]
    return mean, deviation, found, values[order]


def projected(rows: DataFrame, x: str, mean: np.ndarray, deviation: np.ndarray, found: np.ndarray, out: str) -> DataFrame:
    """``rows`` without ``x``, with the coordinates of their standardised arrays along the components."""
    scale = np.where(deviation > 1e-12, 1 / np.where(deviation > 1e-12, deviation, 1.0), 0.0)
    names = [c for c in rows.columns if c != x]

    def project(frames):
        for frame in frames:
            z = (np.stack(frame[x]) - mean) * scale if len(frame) else np.zeros((0, len(mean)))
            yield frame[names].assign(**{out: list(z @ found.T)})

    return rows.mapInPandas(project, ", ".join(f"`{c}` {t}" for c, t in rows.select(*names).dtypes) + f", `{out}` array<double>")
