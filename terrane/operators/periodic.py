"""The null of regional correlation under shifts of space, for observations at any positions.

A shift moves all observations through their unit box, whose sides meet, and each then takes its drivers from
the observation nearest to where it came to lie. The mapping is made once for all targets and drivers.

Nulls are sums of products, and those are linear in the target: instead of sending vectors of drivers to the
observations that take them, each observation's target goes to the observation that it takes from, and is
added up there by shift and domain. Then every observation's drivers are multiplied with its sums, as one
matrix product for many observations, and the products are added up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.numeric import r
from terrane.operators.evidence import from_moments
from terrane.operators.lineage import cut
from terrane.operators.neighbours import periodic_nearest

#: Observations of a matrix product.
ROWS = 256


def unit_box(points: DataFrame, axes: list[str]) -> DataFrame:
    """``points`` with axes scaled to 0 up to, but without, 1; an axis without extent is 0."""
    bounds = points.agg(*[f(c).alias(f"_{n}_{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda c: F.least((F.col(c) - F.col(f"_lo_{c}")) / F.greatest(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(1e-8)), F.lit(0.9999999999999999))
    return points.crossJoin(F.broadcast(bounds)).select(*[scaled(c).alias(c) if c in axes else F.col(c) for c in points.columns])


def random_shifts(n: int, axes: int, seed: int, least: float = 0.1, most: float = 0.9) -> np.ndarray:
    """n shifts, of ``least`` to ``most`` of the box along each axis, to 6 digits; the same for the same seed."""
    return np.round(np.random.default_rng(seed).uniform(least, most, (n, axes)), 6)


def shifted_sources(unit: DataFrame, node: str, axes: list[str], shifts: np.ndarray) -> DataFrame:
    """perm, obs, src: for each shift and observation, the observation nearest to its shifted place; ties by id."""
    moves: list[Column] = [F.struct(F.lit(k).alias("perm"), *[F.lit(float(v)).alias(f"m_{c}") for c, v in zip(axes, row, strict=True)]) for k, row in enumerate(shifts)]
    asked = unit.select(F.col(node).alias("obs"), *axes, F.explode(F.array(*moves)).alias("move"))
    asked = asked.select("obs", "move.perm", *[((F.col(c) + F.col(f"move.m_{c}")) % 1).alias(c) for c in axes])
    found = periodic_nearest(asked, unit.select(F.col(node).alias("obs"), *axes), "obs", axes, keys=["perm", "obs"])
    return found.select("perm", "obs", F.col("nearest").alias("src"))


def shifted_null(signals: DataFrame, sources: DataFrame, perms: int) -> DataFrame:
    """gene, enh, perm, null_max: the largest correlation of a domain, of each target with each shifted driver.

    signals: obs, domain (int), gene, y, x (array over enh, complete, of one length a gene); sources: perm, obs, src.
    Memory is a few matrices of shifts and domains by drivers in a task; what an observation gets is at most
    a sum a shift and domain, however many take from it. Correlations without spread are 0.
    """
    domains = sorted(row[0] for row in signals.select("domain").distinct().collect())
    place = {d: i for i, d in enumerate(domains)}
    targets = signals.select("obs", "gene", "domain", "y")
    taken = sources.join(targets, "obs").groupBy("src", "gene", "perm", "domain").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("sy"))
    packed = taken.groupBy("src", "gene").agg(F.collect_list(F.struct("perm", "domain", "c", "sy")).alias("t")).select("src", "gene", *[F.col(f"t.{c}").alias(c) for c in ("perm", "domain", "c", "sy")])
    means = signals.select("gene", F.posexplode("x").alias("enh", "v")).groupBy("gene", "enh").agg(F.avg("v").alias("m"))
    means = means.groupBy("gene").agg(F.transform(F.array_sort(F.collect_list(F.struct("enh", "m"))), lambda e: e["m"]).alias("mean"))
    drivers = signals.select(F.col("obs").alias("src"), "gene", "x").join(packed, ["src", "gene"]).join(means, "gene")

    def products(frames):
        n, gene, sums, held = perms * len(domains), None, None, []

        def add():
            nonlocal sums
            if not held:
                return
            x = np.stack([h[0] for h in held])
            counts, totals = np.zeros((n, len(held))), np.zeros((n, len(held)))
            for j, (_, at, c, sy) in enumerate(held):
                counts[at, j], totals[at, j] = c, sy
            more = np.stack([counts @ x, counts @ (x * x), totals @ x])
            sums = more if sums is None else sums + more
            held.clear()

        def flush():
            nonlocal sums
            add()
            if sums is not None:
                at = np.arange(n)
                yield pd.DataFrame({"gene": gene, "perm": at // len(domains), "domain": [domains[k] for k in at % len(domains)], "sx": list(sums[0]), "sxx": list(sums[1]), "sxy": list(sums[2])})
            sums = None

        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.gene != gene:
                    yield from flush()
                    gene = row.gene
                at = np.asarray(row.perm) * len(domains) + [place[d] for d in row.domain]
                held.append((np.asarray(row.x, float) - np.asarray(row.mean, float), at, row.c, row.sy))
                if len(held) == ROWS:
                    add()
        yield from flush()

    kind = signals.schema["gene"].dataType.simpleString()
    parts = drivers.select("gene", "x", "mean", "perm", "domain", "c", "sy").sortWithinPartitions("gene").mapInPandas(products, f"gene {kind}, perm int, domain int, sx array<double>, sxx array<double>, sxy array<double>")
    zipped = parts.select("gene", "perm", "domain", F.posexplode(F.arrays_zip("sx", "sxx", "sxy")).alias("enh", "s"))
    sums = zipped.groupBy("gene", "enh", "perm", "domain").agg(*[F.sum(f"s.{c}").alias(c) for c in ("sx", "sxx", "sxy")])
    own = signals.groupBy("gene", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), (F.var_pop("y") * F.count(F.lit(1))).alias("cyy"))
    central = sums.join(own, ["gene", "domain"]).select("gene", "enh", "perm", "n", "cyy", F.expr("sxx - sx * sx / n").alias("cxx"), F.expr("sxy - sx * sy / n").alias("cxy"))
    return cut(central.groupBy("gene", "enh", "perm").agg(F.max(r(from_moments())).alias("null_max")))
