"""The given tables seen as observations, features, links, genes, peaks and pixels.

Observations are embeddings: their first three components are coordinates, components 3 to 10 are the
signals of eight targets ("genes"), 11 to 63 those of 53 candidate drivers ("enhancers"). As raw
drivers track nothing, a known part of them is planted: one in four follows its gene everywhere, one in
four within one domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENES, FIRST_GENE, FIRST_DRIVER, VARS = 8, 3, 11, 64
GRID_ROWS, GRID_COLS, DOMAINS = 76, 101, 6


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """obs_id, x, y, z, label, domain, embedding: bounds are one row, laid beside the scan."""
    base = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("obs_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")], "label", "embedding"
    )
    bounds = base.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    cell = lambda c, k: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * k), F.lit(k - 1))
    return base.crossJoin(F.broadcast(bounds)).select("obs_id", "x", "y", "z", "label", (cell("y", 2) * 3 + cell("x", 3)).cast("int").alias("domain"), "embedding")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """obs_id, x, y, z, label, domain: the domain is a 2 by 3 grid over the bounds of y and x."""
    return _placed(spark, folder).drop("embedding")


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """obs_id, var_id, value (double): the long form of the matrix."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("obs_id"), F.posexplode("embedding").alias("var_id", "v")).select("obs_id", "var_id", F.col("v").cast("double").alias("value"))


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """obs_id, gene, y (not negative)."""
    rows = cells(spark, folder).where(F.col("var_id").between(FIRST_GENE, FIRST_GENE + GENES - 1))
    return rows.select("obs_id", (F.col("var_id") - FIRST_GENE).alias("gene"), F.greatest("value", F.lit(0.0)).alias("y"))


def paired(spark: SparkSession, folder: str) -> DataFrame:
    """obs_id, domain, gene, enh, x, y: every driver of every gene at every observation, planted ones included.

    Both sides come from the same row's array, so pairing is two explodes and no join but with the bounds.
    """
    rows = _placed(spark, folder).select("obs_id", "domain", "embedding")
    genes = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(GENES - 1))).alias("gene"))
    both = genes.select("*", F.explode(F.sequence(F.lit(0), F.lit(VARS - FIRST_DRIVER - 1))).alias("enh"))
    y = F.greatest(F.get("embedding", F.col("gene") + FIRST_GENE).cast("double"), F.lit(0.0))
    v = F.get("embedding", F.col("enh") + FIRST_DRIVER).cast("double")
    seen = both.select("obs_id", "domain", "gene", "enh", y.alias("y"), v.alias("v"))
    x = (
        F.when(F.col("enh") % 4 == 0, 0.5 * F.col("y") + 0.5 * F.col("v"))
        .when((F.col("enh") % 4 == 1) & (F.col("domain") == (F.col("gene") + F.col("enh")) % DOMAINS), F.col("y"))
        .otherwise(F.col("v"))
    )
    return seen.select("obs_id", "domain", "gene", "enh", F.greatest(x, F.lit(0.0)).alias("x"), "y")


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """obs_id, domain, gene, y, x: the same as ``paired``, with a target's drivers as one array."""
    genes = _placed(spark, folder).select("obs_id", "domain", "embedding", F.explode(F.sequence(F.lit(0), F.lit(GENES - 1))).alias("gene"))
    seen = genes.select("obs_id", "domain", "gene", "embedding", F.greatest(F.get("embedding", F.col("gene") + FIRST_GENE).cast("double"), F.lit(0.0)).alias("y"))
    x = f"""transform(slice(embedding, {FIRST_DRIVER + 1}, {VARS - FIRST_DRIVER}), (v, enh) -> greatest(0D, case
        when enh % 4 = 0 then 0.5D * y + 0.5D * cast(v as double) when enh % 4 = 1 and domain = (gene + enh) % {DOMAINS} then y else cast(v as double) end))"""
    return seen.select("obs_id", "domain", "gene", "y", F.expr(x).alias("x"))


def links(spark: SparkSession, folder: str) -> DataFrame:
    """target, region, importance, rho, distance: parts' brands against suppliers."""
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    from terrane.functions.numeric import correlation, moments, r

    grouped = rows.groupBy(F.col("p_brand").alias("target"), F.col("l_suppkey").alias("region")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("importance"), F.min("l_partkey").alias("distance"), *moments("l_quantity", "l_discount")
    )
    return grouped.select("target", "region", "importance", r(correlation("null")).alias("rho"), "distance")


def _points(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    rows = table(spark, folder, "events").where(F.col("event_type") == kind)
    return rows.select(F.col("event_id"), F.col("user_id").alias("chrom"), F.unix_timestamp("ts").alias("pos"), "value")


def genes(spark: SparkSession, folder: str) -> DataFrame:
    """gene, chrom, tss: signups."""
    return _points(spark, folder, "signup").select(F.col("event_id").alias("gene"), "chrom", F.col("pos").alias("tss"))


def peaks(spark: SparkSession, folder: str) -> DataFrame:
    """peak, chrom, start, end, center, signal: purchases, 501 long."""
    return _points(spark, folder, "purchase").select(
        F.col("event_id").alias("peak"), "chrom", (F.col("pos") - 250).alias("start"), (F.col("pos") + 251).alias("end"), F.col("pos").alias("center"), F.col("value").alias("signal")
    )


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """row, col, value: mean quantity by supplier and part; unobserved pixels have no row."""
    keys = [(F.col("l_suppkey") % GRID_ROWS).cast("int").alias("row"), (F.col("l_partkey") % GRID_COLS).cast("int").alias("col")]
    return table(spark, folder, "lineitem").groupBy(*keys).agg(F.avg("l_quantity").alias("value"))


def lattice(spark: SparkSession, rows: int = GRID_ROWS, cols: int = GRID_COLS) -> DataFrame:
    """All (row, col) of a grid."""
    return spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))


#: The same in DuckDB SQL: name -> (names that it needs, definition).
SQL = {
    "base": ((), "select vec_id obs_id, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z, label, embedding from embeddings"),
    "obs": (("base",), "select obs_id, x, y, z, label, (least(floor((y - (select min(y) from base)) / ((select max(y) from base) - (select min(y) from base)) * 2), 1) * 3 + least(floor((x - (select min(x) from base)) / ((select max(x) from base) - (select min(x) from base)) * 3), 2))::int domain from base"),
    "cell": ((), "select vec_id obs_id, unnest(range(64))::int var_id, unnest(embedding)::double v from embeddings"),
    "cells": (("cell",), "select obs_id, var_id, v as value from cell"),
    "targets": (("cells",), "select obs_id, var_id - 3 gene, greatest(value, 0) y from cells where var_id between 3 and 10"),
    "paired": (("cells", "obs"), "select t.obs_id, o.domain, t.var_id - 3 gene, d.var_id - 11 enh, greatest(case when (d.var_id - 11) % 4 = 0 then .5::double * greatest(t.value, 0) + .5::double * d.value when (d.var_id - 11) % 4 = 1 and o.domain = (t.var_id - 3 + d.var_id - 11) % 6 then greatest(t.value, 0) else d.value end, 0) x, greatest(t.value, 0) y from cells t join cells d on t.obs_id = d.obs_id and t.var_id between 3 and 10 and d.var_id >= 11 join obs o on o.obs_id = t.obs_id"),
    "links": ((), "select p_brand target, l_suppkey region, round(sum(l_extendedprice), 2) importance, round(case when count(*) >= 3 and stddev_pop(l_quantity) >= 1e-8 and stddev_pop(l_discount) >= 1e-8 then covar_pop(l_quantity, l_discount) / (stddev_pop(l_quantity) * stddev_pop(l_discount)) end, 6) + 0.0 rho, min(l_partkey) distance from lineitem join part on l_partkey = p_partkey group by all"),
    "genes": ((), "select event_id gene, user_id chrom, epoch(ts)::bigint tss_ from events where event_type = 'signup'"),
    "gene": (("genes",), "select g.event_id gene, g.user_id chrom, (epoch_us(ts) // 1000000)::bigint tss from events g where event_type = 'signup'"),
    "peak": ((), "select event_id peak, user_id chrom, (epoch_us(ts) // 1000000)::bigint - 250 \"start\", (epoch_us(ts) // 1000000)::bigint + 251 \"end\", (epoch_us(ts) // 1000000)::bigint center, value signal from events where event_type = 'purchase'"),
    "pixel": ((), "select (l_suppkey % 76)::int \"row\", (l_partkey % 101)::int col, avg(l_quantity) as value from lineitem group by all"),
}
SQL["gene"] = ((), SQL["gene"][1])
del SQL["genes"]
