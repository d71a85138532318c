"""Raster operators on pixel tables (by..., row, col, v): filters, stencils, components, masks.

A stencil is a window over a row's or a column's neighbours, twice for a square one, so no pixel is
copied nine times; larger kernels are one equi join a direction with a small table of taps.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.numeric import pick
from terrane.operators.components import connected_components
from terrane.operators.lineage import cut


def scatter(grid: DataFrame, pixels: DataFrame, value: str = "value") -> DataFrame:
    """All pixels of the grid with their value, null where unobserved."""
    return grid.join(pixels, ["row", "col"], "left").select("row", "col", F.col(value).alias("v"))


def rasterise(points: DataFrame, size: float, value: str, by: list[str] | None = None) -> DataFrame:
    """row, col, v, n: mean of the points in each bin; bins count from the least coordinates."""
    low = points.agg(F.min("x").alias("lx"), F.min("y").alias("ly"))
    binned = points.crossJoin(F.broadcast(low)).select(
        *(by or []), F.floor((F.col("y") - F.col("ly")) / size + 1e-8).cast("int").alias("row"), F.floor((F.col("x") - F.col("lx")) / size + 1e-8).cast("int").alias("col"), F.col(value).alias("v")
    )
    return binned.groupBy(*(by or []), "row", "col").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))


def _line(by: list[str], along: str, across: str):
    return Window.partitionBy(*by, across).orderBy(along)


def square_sum(frame: DataFrame, by: list[str] | None = None, value: str = "v", out: str = "s") -> DataFrame:
    """``frame`` with the sum over the 3x3 square around each pixel; edges repeat. The grid must be full."""
    by = by or []
    across, down = _line(by, "col", "row"), _line(by, "row", "col")
    wide = frame.withColumn("_w", F.col(value) + F.coalesce(F.lag(value).over(across), F.col(value)) + F.coalesce(F.lead(value).over(across), F.col(value)))
    return wide.withColumn(out, F.col("_w") + F.coalesce(F.lag("_w").over(down), F.col("_w")) + F.coalesce(F.lead("_w").over(down), F.col("_w"))).drop("_w")


def majority(mask: DataFrame, rounds: int = 3, least: int = 5, by: list[str] | None = None) -> DataFrame:
    """A 0/1 mask (column v) after rounds of 3x3 votes, the pixel itself and repeated edges included."""
    for _ in range(rounds):
        mask = square_sum(mask, by).withColumn("v", (F.col("s") >= least).cast("int")).drop("s")
    return mask


def graph_majority(mask: DataFrame, edges: DataFrame, rounds: int = 3, least: int = 5, by: list[str] | None = None) -> DataFrame:
    """A 0/1 mask (by, obs_id, v) after rounds of votes of each point's neighbours (src, dst)."""
    by = by or []
    for _ in range(rounds):
        votes = edges.join(mask.withColumnRenamed("obs_id", "dst"), [*([b for b in by if b in edges.columns]), "dst"]).groupBy(*by, "src").agg(F.sum("v").alias("s"))
        mask = votes.select(*by, F.col("src").alias("obs_id"), (F.col("s") >= least).cast("int").alias("v"))
    return mask


def zoom(frame: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """row, col, v at a lower (or higher) resolution by linear interpolation; corners meet corners."""
    spark = frame.sparkSession

    def taps(n: int, m: int, out: str) -> DataFrame:
        step = (n - 1) / max(m - 1, 1)
        rows = []
        for i in range(m):
            at = i * step
            low = min(int(math.floor(at + 1e-12)), n - 1)
            rest = at - low
            rows += [(i, low, 1 - rest)] + ([(i, low + 1, rest)] if rest > 1e-12 and low + 1 < n else [])
        return spark.createDataFrame(rows, f"{out} int, src int, w double")

    tall = frame.join(F.broadcast(taps(size[0], to[0], "r2")), F.col("row") == F.col("src")).groupBy("r2", "col").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return tall.join(F.broadcast(taps(size[1], to[1], "c2")), F.col("col") == F.col("src")).groupBy(F.col("r2").alias("row"), F.col("c2").alias("col")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def gaussian(frame: DataFrame, sigma: float, size: tuple[int, int], mode: str = "reflect", by: list[str] | None = None) -> DataFrame:
    """The Gaussian filter, one direction after the other; radius int(4 sigma + 0.5), edges mirrored or repeated."""
    by = by or []
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    taps = F.array(*[F.struct(F.lit(k - radius).alias("k"), F.lit(w / sum(weights)).alias("w")) for k, w in enumerate(weights)])
    out = frame
    for along, n in (("row", size[0]), ("col", size[1])):
        other = "col" if along == "row" else "row"
        asked = out.select(*by, "row", "col", F.explode(taps).alias("t"))
        at = F.col(along) + F.col("t.k")
        if mode == "reflect":
            turned = F.pmod(at, F.lit(2 * n))
            src = F.when(turned < n, turned).otherwise(2 * n - 1 - turned)
        else:
            src = F.least(F.greatest(at, F.lit(0)), F.lit(n - 1))
        wanted = asked.select(*by, F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("t.w").alias("w"), src.cast("int").alias(along), F.col(other))
        out = wanted.join(out, [*by, "row", "col"]).groupBy(*by, "r0", "c0").agg(F.sum(F.col("w") * F.col("v")).alias("v")).select(*by, F.col("r0").alias("row"), F.col("c0").alias("col"), "v")
    return out


def components(hot: DataFrame, cols: int, rows: int, by: list[str] | None = None) -> DataFrame:
    """by, row, col, component: 8-connected components of the hot pixels, named by their least pixel.

    Groups are numbered, so that no two share a node's id; null is a group of its own.
    """
    by = by or []
    cell = F.col("row").cast("bigint") * cols + F.col("col")
    if by:
        numbers = cut(hot.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct().withColumn("_group", F.monotonically_increasing_id()))
        here = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
        grouped = hot.join(numbers, here)
    else:
        grouped = hot.withColumn("_group", F.lit(0).cast("bigint"))
    named = cut(grouped.select(*by, "_group", "row", "col", (F.col("_group") * (rows * cols) + cell).alias("id")))
    ahead = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    asked = named.select("_group", "id", "row", "col", ahead.alias("o")).select("_group", F.col("id").alias("u"), (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    edges = asked.join(named.select("_group", "row", "col", F.col("id").alias("v")), ["_group", "row", "col"]).select("u", "v")
    groups = connected_components(edges)
    least = F.coalesce("component", "id") - F.col("_group") * (rows * cols)
    return named.join(groups, named["id"] == groups["node"], "left").select(*by, "row", "col", least.alias("component"))


def component_stats(comps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, n_components, largest, hot, largest_fraction."""
    sizes = comps.groupBy(*(by or []), "component").agg(F.count(F.lit(1)).alias("k"))
    got = sizes.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_components"), F.max("k").alias("largest"), F.sum("k").alias("hot"))
    return got.withColumn("largest_fraction", F.col("largest") / F.col("hot"))


def keep_largest(comps: DataFrame, least: int = 25, most: int = 2, by: list[str] | None = None) -> DataFrame:
    """The pixels of the ``most`` largest components of at least ``least`` pixels; ties by the least pixel. Adds ``place``."""
    by = by or []
    sizes = comps.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least)
    chosen = sizes.withColumn("place", pick([F.desc("k"), F.col("component")], by) if by else F.row_number().over(Window.orderBy(F.desc("k"), "component"))).where(F.col("place") <= most)
    return comps.join(chosen.select(*by, "component", "place"), [*by, "component"])


def compactness(mask: DataFrame, rows: int, cols: int, by: list[str] | None = None) -> DataFrame:
    """by, area, perimeter, compactness of the pixels in ``mask`` (row, col); pixels beyond the grid count as empty.

    Steps between pixels of the grid are seen from both sides, steps off the grid from within.
    """
    by = by or []
    dirs = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    asked = mask.select(*by, "row", "col", dirs.alias("o")).select(*by, (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    open_ = asked.join(mask.select(*by, "row", "col"), [*by, "row", "col"], "left_anti")
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    area = mask.groupBy(*by).agg(F.count(F.lit(1)).alias("area"))
    edge = open_.groupBy(*by).agg(F.coalesce(F.sum(F.when(inside, 2).otherwise(1)), F.lit(0)).alias("perimeter"))
    both = edge.join(area, by) if by else edge.crossJoin(F.broadcast(area))
    return both.withColumn("compactness", F.when(F.col("area") > 0, F.col("area") / (F.col("perimeter") + 1e-8)).otherwise(0.0))


def hysteresis(low: DataFrame, high: DataFrame, cols: int, rows: int) -> DataFrame:
    """Pixels of ``low`` whose component holds a pixel of ``high``."""
    comps = components(low, cols, rows)
    seeds = comps.join(high.select("row", "col"), ["row", "col"], "left_semi").select("component").distinct()
    return comps.join(seeds, "component", "left_semi")


def two_state(values: DataFrame, by: list[str], value: str = "v", rounds: int = 25) -> DataFrame:
    """by, low, high: centres of a two-means split that starts from the quartiles.

    A round is one grouped mean; it ends early when no centre moves. Only centres (one row a group) are kept.
    """
    values = cut(values.select(*by, F.col(value).cast("double").alias("v")))
    centres = cut(values.groupBy(*by).agg(F.percentile("v", F.lit(0.25)).alias("c0"), F.percentile("v", F.lit(0.75)).alias("c1")))
    upper = F.abs(F.col("v") - F.col("c1")) < F.abs(F.col("v") - F.col("c0"))
    for _ in range(rounds):
        now = values.join(centres, by).groupBy(*by).agg(F.avg(F.when(~upper, F.col("v"))).alias("m0"), F.avg(F.when(upper, F.col("v"))).alias("m1"), F.first("c0").alias("c0"), F.first("c1").alias("c1"))
        now = cut(now.select(*by, F.coalesce("m0", "c0").alias("n0"), F.coalesce("m1", "c1").alias("n1"), "c0", "c1"))
        moved = now.where("abs(n0 - c0) > 1e-15 or abs(n1 - c1) > 1e-15").limit(1).count()
        centres = now.select(*by, F.col("n0").alias("c0"), F.col("n1").alias("c1"))
        if not moved:
            break
    return centres.select(*by, F.least("c0", "c1").alias("low"), F.greatest("c0", "c1").alias("high"))


def bounds(pixels: DataFrame, along: str, across: str, lines: DataFrame) -> DataFrame:
    """Per line (``across``): least and greatest observed place, gaps filled between and beyond observed lines."""
    seen = lines.join(pixels.groupBy(across).agg(F.min(along).cast("double").alias("lo"), F.max(along).cast("double").alias("hi")), across, "left")
    before = Window.orderBy(across).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.orderBy(across).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    place = F.when(F.col("lo").isNotNull(), F.col(across))
    out = seen.select("*", F.last(place, True).over(before).alias("p0"), F.first(place, True).over(after).alias("p1"), *[f.over(w).alias(n) for c in ("lo", "hi") for f, w, n in ((F.last(c, True), before, f"{c}0"), (F.first(c, True), after, f"{c}1"))])
    share = (F.col(across) - F.col("p0")) / (F.col("p1") - F.col("p0"))
    fill = lambda c: F.when(F.col("p0").isNull(), F.col(f"{c}1")).when(F.col("p1").isNull(), F.col(f"{c}0")).when(F.col("p0") == F.col("p1"), F.col(c)).otherwise(F.col(f"{c}0") + share * (F.col(f"{c}1") - F.col(f"{c}0")))
    return out.select(across, fill("lo").alias("lo"), fill("hi").alias("hi"))


def moran(values: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """by, moran: Moran's I with each point's neighbours weighing the same; 0 where the variance is below 1e-12.

    values: by, obs_id, v; edges: src, dst (and by, if graphs differ).
    """
    shared = [b for b in by if b in edges.columns]
    mean = values.groupBy(*by).agg(F.avg("v").alias("m"), F.var_pop("v").alias("var"))
    z = values.join(mean, by).select(*by, "obs_id", (F.col("v") - F.col("m")).alias("z"), "var")
    lag = edges.join(z.select(*by, F.col("obs_id").alias("dst"), F.col("z").alias("zd")), [*shared, "dst"]).groupBy(*by, "src").agg(F.avg("zd").alias("lag"))
    joined = z.join(lag.withColumnRenamed("src", "obs_id"), [*by, "obs_id"])
    return joined.groupBy(*by).agg(F.when(F.first("var") < 1e-12, 0.0).otherwise(F.sum(F.col("z") * F.col("lag")) / F.sum(F.col("z") * F.col("z"))).alias("moran"))
