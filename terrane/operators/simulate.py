"""Generated test tables with known truth: pixel tables from expressions over a lattice.

Noise is a hash of (seed, name, pixel and what was observed there) turned into a number, so tables don't depend on partitions,
engines' generators or the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.raster import gaussian

SEED = 90_417
SCENARIOS = ("single", "redundant", "complementary", "spatial_complementary", "partial_switching", "unrelated_missing_factor")


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and keys alone."""
    h = F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number from two uniform ones."""
    u, v = F.greatest(uniform(seed, *keys), F.lit(1e-12)), uniform(seed + 1, *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)


def blob(x0: float, y0: float, sigma: float) -> Column:
    """A Gaussian spot over x and y."""
    return F.exp(-((F.col("x") - x0) ** 2 + (F.col("y") - y0) ** 2) / (2 * sigma * sigma))


def grid(spark: SparkSession, rows: int, cols: int, seen: DataFrame | None = None) -> DataFrame:
    """row, col, x, y (0 to 1) and tissue, an ellipse; with ``seen`` (row, col, value), also key: what was observed at the pixel."""
    base = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    placed = base.withColumn("x", F.col("col") / float(max(cols - 1, 1))).withColumn("y", F.col("row") / float(max(rows - 1, 1)))
    placed = placed.withColumn("tissue", ((F.col("x") - 0.5) / 0.48) ** 2 + ((F.col("y") - 0.5) / 0.43) ** 2 <= 1)
    if seen is None:
        return placed
    return placed.join(seen.select("row", "col", F.round(F.col("value") * 1e6).cast("long").alias("key")), ["row", "col"], "left").fillna(0, ["key"])


def smooth_field(base: DataFrame, value: Column, sigma: float, size: tuple[int, int], name: str, scaled: bool = False) -> DataFrame:
    """row, col and ``name``: the values after a Gaussian filter; ``scaled`` to a standard deviation of 1 over the tissue."""
    smooth = gaussian(base.select("row", "col", value.alias("v")), sigma, size)
    if not scaled:
        return smooth.withColumnRenamed("v", name)
    spread = smooth.join(base.where("tissue").select("row", "col"), ["row", "col"]).agg((F.stddev_pop("v") + 1e-8).alias("_spread"))
    return smooth.crossJoin(F.broadcast(spread)).select("row", "col", (F.col("v") / F.col("_spread")).alias(name))


def decomposition(spark: SparkSession, scenario: str = "complementary", rows: int = 48, cols: int = 64, drivers: int = 4, noise: float = 0.0, seed: int = SEED, seen: DataFrame | None = None) -> DataFrame:
    """row, col, tissue, enh, activity, attribution, gene: a gene made of known parts of its drivers.

    Drivers from the third on are unrelated: smooth fields. The gene's noise is a smooth field of standard
    deviation ``noise``, the drivers' noise is white and half as strong. In the last scenario the true driver
    isn't among the candidates.
    """
    if scenario not in SCENARIOS:
        raise ValueError(f"no scenario is called {scenario!r}; there are {', '.join(SCENARIOS)}")
    if drivers < 2:
        raise ValueError(f"a decomposition has two drivers or more, not {drivers}")
    size, base = (rows, cols), grid(spark, rows, cols, seen)
    at = ["row", "col", *(["key"] if seen is not None else [])]
    fields = [smooth_field(base, uniform(seed + 100 + i, *at), 2.5, size, f"_field{i}") for i in range(2, drivers)]
    if scenario == "unrelated_missing_factor":
        fields.append(smooth_field(base, uniform(seed + 5, *at), 2.0, size, "_field1"))
    if noise:
        fields.append(smooth_field(base, normal(seed + 7, *at), 1.2, size, "_noise", scaled=True))
    placed = reduce(lambda frame, field: frame.join(field, ["row", "col"]), fields, base)
    t = F.col("tissue").cast("double")
    left, right, top = blob(0.30, 0.50, 0.16) * t, blob(0.70, 0.50, 0.16) * t, blob(0.50, 0.28, 0.15) * t
    zero, west = F.lit(0.0), (F.col("x") <= 0.5).cast("double")
    blend = F.least(F.greatest((0.58 - F.col("x")) / 0.16, zero), F.lit(1.0)) * t
    both = (west * t, (1 - west) * t)
    if scenario == "single":
        (a0, a1), (w0, w1) = (left, right), (t, zero)
    elif scenario == "redundant":
        (a0, a1), (w0, w1) = (left, F.greatest(left + 0.025 * noise * normal(seed, *at), zero) * t), (0.5 * t, 0.5 * t)
    elif scenario == "complementary":
        (a0, a1), (w0, w1) = (left, right), both
    elif scenario == "spatial_complementary":
        (a0, a1), (w0, w1) = (left + 0.80 * right, 0.80 * left + 0.40 * right), both
    elif scenario == "partial_switching":
        (a0, a1), (w0, w1) = (left + 0.25 * top, right + 0.25 * top), (blend, t - blend)
    else:
        (a0, a1), (w0, w1) = (right, F.col("_field1") * t), (zero, zero)
    clean = left if scenario == "unrelated_missing_factor" else a0 * w0 + a1 * w1
    gene = F.greatest(clean + noise * F.col("_noise") * t, zero) if noise else clean
    jitter = lambda i: 0.5 * noise * normal(seed + 200 + i, *at) * t
    every = [(a0, w0), (a1, w1), *((F.col(f"_field{i}") * t, zero) for i in range(2, drivers))]
    listed = F.array(*[F.struct(F.lit(i).alias("enh"), (F.greatest(a + jitter(i), zero) if noise else a).alias("activity"), w.alias("attribution")) for i, (a, w) in enumerate(every)])
    return placed.select("row", "col", "tissue", gene.alias("gene"), F.explode(listed).alias("e")).select("row", "col", "tissue", "gene", "e.*")


def mixed_complexity(spark: SparkSession, rows: int = 48, cols: int = 64, noise: float = 0.04, seed: int = SEED, seen: DataFrame | None = None) -> DataFrame:
    """row, col, tissue, gene, enh, activity, truth, truth_domain: 10 core, 3 regional, 2 redundant regional, 5 unrelated drivers."""
    base = grid(spark, rows, cols, seen)
    at = ["row", "col", *(["key"] if seen is not None else [])]
    t = F.col("tissue").cast("double")
    latent = (0.85 * blob(0.28, 0.52, 0.17) + 0.72 * blob(0.70, 0.52, 0.16) + 0.48 * blob(0.50, 0.25, 0.13)) * t
    gene = F.greatest(latent + noise * normal(seed, *at) * t, F.lit(0.0))
    raw = base.withColumn("gene", gene).withColumn("enh", F.explode(F.sequence(F.lit(0), F.lit(19))))
    smooth_in = raw.select("enh", "row", "col", uniform(seed + 11, "enh", *at).alias("v"))
    smooth = gaussian(smooth_in, 2.2, (rows, cols), by=["enh"]).withColumnRenamed("v", "field")
    joined = raw.join(smooth, ["enh", "row", "col"])
    domain = F.when(F.col("enh").isin(10, 13), 0).when(F.col("enh").isin(11, 14), 1).when(F.col("enh") == 12, 2).otherwise(-1)
    inside = ((F.col("d") == 0) & (F.col("x") < 0.40)) | ((F.col("d") == 1) & (F.col("x") > 0.60)) | ((F.col("d") == 2) & (F.col("y") < 0.42))
    jitter = normal(seed + 21, "enh", *at)
    value = F.when(F.col("enh") < 10, (0.75 + 0.05 * F.col("enh")) * F.col("gene") + 0.02 * jitter).when(F.col("enh") < 15, F.when(inside, F.col("gene") + 0.01 * jitter).otherwise(F.col("field"))).otherwise(F.col("field"))
    made = joined.withColumn("d", domain).withColumn("activity", F.greatest((value + noise * 0.25 * normal(seed + 31, "enh", *at)) * t, F.lit(0.0)))
    truth = F.when(F.col("enh") < 10, "core_concordant").when(F.col("enh") < 13, "regional_specific").when(F.col("enh") < 15, "regional_redundant").otherwise("unsupported")
    return made.select("row", "col", "x", "y", "tissue", "gene", "enh", "activity", truth.alias("truth"), F.col("d").alias("truth_domain"))
