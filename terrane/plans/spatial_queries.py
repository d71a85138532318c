"""Queries: rasters, masks, neighbours, structure scores, network complexity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.numeric import correlation, moments, r
from terrane.operators import clusters as C
from terrane.operators import linear as L
from terrane.operators import neighbours as N
from terrane.operators import raster as S
from terrane.operators import triangles as T
from terrane.operators.lineage import cut
from terrane.plans.registry import query
from terrane.sources import adapters as A

ROWS, COLS = A.GRID_ROWS, A.GRID_COLS
#: A full grid with structure: a wave of the row and column, and the observed quantity on top.
LAT = {
    "lat": 'select r.r "row", c.c col, p.value v from (select unnest(range(76))::int r) r cross join (select unnest(range(101))::int c) c left join pixel p on p."row" = r.r and p.col = c.c',
    "g": 'select "row", col, round(sin("row" / 9.0::double) * cos(col / 11.0::double) * 10 + coalesce(v, 0) / 10, 6) + 0.0 v from lat',
}


def _lattice(s, d):
    return S.scatter(A.lattice(s), A.pixels(s, d))


def _wave(s, d):
    return _lattice(s, d).withColumn("v", r(F.sin(F.col("row") / 9.0) * F.cos(F.col("col") / 11.0) * 10 + F.coalesce("v", F.lit(0.0)) / 10))


def _cutoff(frame, q, value="v"):
    """One row: the quantile t (rounded) of the values."""
    return frame.agg(F.round(F.percentile(value, F.lit(q)), 6).alias("t"))


def _above(frame, q):
    return frame.crossJoin(F.broadcast(_cutoff(frame, q))).where(F.col("v") >= F.col("t")).select("row", "col")


@query("SPA-03", "pixel", 'select "row", col, round(v, 6) + 0.0 v from lat', LAT)
def scatter_grid(s, d):
    return _lattice(s, d).select("row", "col", r("v").alias("v"))


@query("SPA-04", "obs", 'select floor((y - (select min(y) from obs)) / .02 + 1e-8)::int "row", floor((x - (select min(x) from obs)) / .02 + 1e-8)::int col, round(avg(z), 6) + 0.0 v, count(*) n from obs group by all')
def rasterised(s, d):
    return S.rasterise(A.observations(s, d), 0.02, "z").select("row", "col", r("v").alias("v"), "n")


_TAPS = {
    "ry": "select i r2, low src, 1 - (i * st - low) w from (select i, st, least(floor(i * st + 1e-12), 75)::int low from (select unnest(range(19)) i, 75.0::double / 18 st)) union all select i, low + 1, i * st - low from (select i, st, least(floor(i * st + 1e-12), 75)::int low from (select unnest(range(19)) i, 75.0::double / 18 st)) where i * st - low > 1e-12 and low + 1 < 76",
    "cx": "select i c2, low src, 1 - (i * st - low) w from (select i, st, least(floor(i * st + 1e-12), 100)::int low from (select unnest(range(25)) i, 100.0::double / 24 st)) union all select i, low + 1, i * st - low from (select i, st, least(floor(i * st + 1e-12), 100)::int low from (select unnest(range(25)) i, 100.0::double / 24 st)) where i * st - low > 1e-12 and low + 1 < 101",
}


@query("SPA-05", "pixel", 'select r2::int "row", c2::int col, round(sum(v * ry.w * cx.w), 8) + 0.0 v from g join ry on ry.src = g."row" join cx on cx.src = g.col group by all', LAT | _TAPS)
def zoomed(s, d):
    return S.zoom(_wave(s, d), (ROWS, COLS), (19, 25)).select("row", "col", r("v", 8).alias("v"))


# Rounded in whole millionths: a mean that lies between two digits then goes the same way in any order of summing.
@query("SPA-06", "pixel", 'select "row", col, (a - ((a % b) + b) % b) // b / 1e5::double v from (select ("row" * 19 // 76)::int "row", (col * 25 // 101)::int col, (2 * sum(round(v * 1e6)::bigint) + 10 * count(*))::bigint a, 20 * count(*) b from g group by all)', LAT)
def low_resolution(s, d):
    millionths = F.round(F.col("v") * 1e6).cast("long")
    cells = _wave(s, d).groupBy((F.col("row") * 19 / 76).cast("int").alias("row"), (F.col("col") * 25 / 101).cast("int").alias("col"))
    halves = cells.agg((2 * F.sum(millionths) + 10 * F.count(F.lit(1))).alias("a"), (20 * F.count(F.lit(1))).alias("b"))
    return halves.select("row", "col", (F.expr("(a - pmod(a, b)) div b") / 1e5).alias("v"))


_TWO = {
    "nv": "select gene, obs_id, (y - min(y) over (partition by gene)) / greatest(max(y) over (partition by gene) - min(y) over (partition by gene), 1e-8) v from targets",
    "it": "select 0 i, gene, quantile_cont(v, .25) c0, quantile_cont(v, .75) c1 from nv group by gene union all select any_value(it.i) + 1, it.gene, coalesce(avg(case when not abs(v - c1) < abs(v - c0) then v end), any_value(c0)), coalesce(avg(case when abs(v - c1) < abs(v - c0) then v end), any_value(c1)) from it join nv on nv.gene = it.gene where it.i < 25 group by it.gene",
    "ce": "select gene, least(c0, c1) low, greatest(c0, c1) high from it where i = 25",
    "mk": "select nv.gene, obs_id, (v > (low + high) / 2)::int v from nv join ce using (gene)",
}


def _normalised(s, d):
    w = Window.partitionBy("gene")
    return A.targets(s, d).select("gene", "obs_id", "y", ((F.col("y") - F.min("y").over(w)) / F.greatest(F.max("y").over(w) - F.min("y").over(w), F.lit(1e-8))).alias("v"))


def _mask(s, d):
    n = _normalised(s, d)
    c = S.two_state(n, ["gene"])
    return n.join(c, "gene").select("gene", "obs_id", (F.col("v") > (F.col("low") + F.col("high")) / 2).cast("int").alias("v"))


@query("SPA-07", "targets", "select gene, round(low, 6) + 0.0 low, round(high, 6) + 0.0 high, (select count_if(v = 1) from mk where mk.gene = ce.gene) n from ce", _TWO)
def two_state_centres(s, d):
    c = S.two_state(_normalised(s, d), ["gene"])
    n = _mask(s, d).groupBy("gene").agg(F.sum("v").cast("long").alias("n"))
    return c.join(n, "gene").select("gene", r("low").alias("low"), r("high").alias("high"), "n")


_MAJ = {"m0": 'select "row" rr, col cc, (v > 2)::int v from g'} | {
    f"m{i}": f"select a.rr, a.cc, (sum(b.v) >= 5)::int v from m{i - 1} a, (select unnest([-1, 0, 1]) dr) x, (select unnest([-1, 0, 1]) dc) y, m{i - 1} b where b.rr = least(greatest(a.rr + dr, 0), 75) and b.cc = least(greatest(a.cc + dc, 0), 100) group by a.rr, a.cc" for i in (1, 2, 3)
}


@query("SPA-08 REL-17", "pixel", 'select rr "row", cc col, v from m3', LAT | _MAJ)
def grid_majority(s, d):
    return S.majority(_wave(s, d).withColumn("v", (F.col("v") > 2).cast("int"))).select("row", "col", "v")


_KNN = "select a.obs_id src, b.obs_id dst, row_number() over (partition by a.obs_id order by round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 9), b.obs_id) rank from obs a join obs b on a.obs_id <> b.obs_id"
_VOTE = {"nn": f"select src, dst from ({_KNN}) where rank <= 9"} | {"k0": "select gene, obs_id, v from mk"} | {f"k{i}": f"select gene, src obs_id, (sum(v) >= 5)::int v from nn join k{i - 1} m on m.obs_id = nn.dst group by gene, src" for i in (1, 2, 3)}


@query("SPA-09", "targets obs", "select gene, sum(v)::bigint n, sum(v * obs_id)::bigint checksum from k3 group by gene", _TWO | _VOTE)
def graph_majority(s, d):
    edges = N.nearest_points(A.observations(s, d), 9, ["x", "y", "z"]).select("src", "dst")
    m = S.graph_majority(_mask(s, d), edges, by=["gene"])
    return m.groupBy("gene").agg(F.sum("v").cast("long").alias("n"), F.sum(F.col("v") * F.col("obs_id")).cast("long").alias("checksum"))


def _comp(hot: str) -> dict[str, str]:
    """Components of a set of pixels in SQL: reachable pairs, then the least."""
    return {
        "h": f"select \"row\" * 101 + col id, \"row\" rr, col cc from ({hot})",
        "e": "select a.id u, b.id v from h a join h b on abs(a.rr - b.rr) <= 1 and abs(a.cc - b.cc) <= 1",
        "re": "select id, id lab from h union select re.id, e.v from re join e on e.u = re.lab",
        "cp": "select id, min(lab) component from re group by id",
        "sz": "select component, count(*) k from cp group by component",
    }


_HOT = 'select "row", col from g where v >= (select round(quantile_cont(v, .9), 6) from g)'


@query("SPA-10", "pixel", "select count(*) n_components, max(k) largest, sum(k)::bigint hot, round(max(k)::double / sum(k), 6) largest_fraction from sz", LAT | _comp(_HOT))
def grid_components(s, d):
    got = S.component_stats(S.components(_above(_wave(s, d), 0.9), COLS, ROWS))
    return got.select("n_components", "largest", "hot", r("largest_fraction").alias("largest_fraction"))


_BIG = {"kp": "select component, k, row_number() over (order by k desc, component) place from sz where k >= 25", "km": "select cp.id // 101 rr, cp.id % 101 cc, place from cp join kp using (component) where place <= 2"}


@query("SPA-12 SPA-15", "pixel", 'select rr "row", cc col, place from km', LAT | _comp(_HOT.replace(".9)", ".92)")) | _BIG)
def largest_components(s, d):
    kept = S.keep_largest(S.components(_above(_wave(s, d), 0.92), COLS, ROWS))
    return kept.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("place").cast("long").alias("place"))


@query("SPA-13", "pixel", "select count(*) n_domains, round(case when count(*) = 2 then min(k)::double / max(k) else 0 end, 6) + 0.0 balance from kp where place <= 2", LAT | _comp(_HOT.replace(".9)", ".8)")) | _BIG)
def expression_domains(s, d):
    kept = S.keep_largest(S.components(_above(_wave(s, d), 0.8), COLS, ROWS)).groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    return kept.agg(F.count(F.lit(1)).alias("n_domains"), r(F.when(F.count(F.lit(1)) == 2, F.min("k") / F.max("k")).otherwise(0.0)).alias("balance"))


@query("SPA-14", "pixel", """select (select count(*) from hh) area, sum(case when r2 between 0 and 75 and c2 between 0 and 100 then 2 else 1 end)::bigint perimeter, round((select count(*) from hh) / (sum(case when r2 between 0 and 75 and c2 between 0 and 100 then 2 else 1 end) + 1e-8), 6) compactness
from (select rr + dr r2, cc + dc c2 from hh, (values (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc)) q where not exists (select 1 from hh where hh.rr = q.r2 and hh.cc = q.c2)""", LAT | {"hh": f'select "row" rr, col cc from ({_HOT})'})
def mask_compactness(s, d):
    return S.compactness(_above(_wave(s, d), 0.9), ROWS, COLS).select("area", F.col("perimeter").cast("long").alias("perimeter"), r("compactness").alias("compactness"))


@query("SPA-17", "pixel", 'select count(*) n, sum("row" * 101 + col)::bigint checksum from g, th where v >= t', LAT | {"md": "select median(v) m from g", "th": "select round(m + 1.0 * 1.4826 * (select median(abs(v - m)) + 1e-8 from g), 6) t from md"})
def mad_mask(s, d):
    g = _wave(s, d)
    m = g.agg(F.percentile("v", F.lit(0.5)).alias("m"))
    t = g.crossJoin(F.broadcast(m)).agg(F.first("m").alias("m"), F.percentile(F.abs(F.col("v") - F.col("m")), F.lit(0.5)).alias("mad")).select(F.round(F.col("m") + 1.0 * 1.4826 * (F.col("mad") + 1e-8), 6).alias("t"))
    return g.crossJoin(F.broadcast(t)).where("v >= t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("row") * 101 + F.col("col")).cast("long").alias("checksum"))


@query("SPA-19", "pixel", 'select cp.id // 101 "row", cp.id % 101 col from cp where component in (select component from cp where id in (select "row" * 101 + col from g where v >= (select round(quantile_cont(v, .97), 6) from g)))', LAT | _comp(_HOT.replace(".9)", ".88)")))
def hysteresis_mask(s, d):
    g = _wave(s, d)
    return S.hysteresis(_above(g, 0.88), _above(g, 0.97), COLS, ROWS).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


@query("SPA-16")
def adaptive_quantile_mask(s, d):
    """The best of 17 quantiles by a score of size, compactness, area and number of components."""
    g = _wave(s, d)
    cuts = g.agg(F.percentile("v", F.array(*[F.lit(0.82 + 0.01 * k) for k in range(17)])).alias("t")).select(F.posexplode("t").alias("q", "t"))
    hot = g.crossJoin(F.broadcast(cuts)).where("v >= t").select("q", "row", "col")
    kept = cut(S.keep_largest(S.components(hot, COLS, ROWS, by=["q"]), by=["q"]))
    sizes = kept.groupBy("q", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("big"))
    score = 1.2 * F.col("big") / F.col("area") + F.col("compactness") - 0.8 * F.col("area") / (ROWS * COLS) - 0.15 * F.greatest(F.col("n") - 2, F.lit(0))
    scored = S.compactness(kept, ROWS, COLS, by=["q"]).join(sizes, "q").where("area between 80 and 2200").select((0.82 + 0.01 * F.col("q")).alias("q"), "area", "n", score.alias("score"))
    return scored.orderBy(F.desc("score"), "q").limit(1)


@query("SPA-18")
def mixture_mask(s, d):
    """Posterior of the higher of two Gaussians, fitted by EM to counts of rounded values; pixels at 0.5 or more."""
    from terrane.operators.masks import mixture

    g = _wave(s, d).withColumn("b", F.round("v", 3))
    m = mixture(g.groupBy("b").agg(F.count(F.lit(1)).alias("n")))
    p = [F.lit(m[f"w_{k}"] / m[f"sd_{k}"]) * F.exp(-0.5 * F.pow((F.col("v") - m[f"mu_{k}"]) / m[f"sd_{k}"], F.lit(2.0))) for k in ("low", "high")]
    return g.withColumn("posterior", p[1] / (p[0] + p[1] + 1e-12)).where("posterior >= 0.5").select("row", "col", r("posterior").alias("posterior"))


def _largest(mask):
    """The pixels of the two largest components of a mask."""
    return S.keep_largest(S.components(mask.select("row", "col"), COLS, ROWS)).select("row", "col")


@query("SPA-20")
def random_walker_mask(s, d):
    """Probability of reaching the bright seeds before the dark ones, solved on the pixel graph; the largest components."""
    from terrane.operators.masks import random_walker

    found = random_walker(_wave(s, d), (ROWS, COLS))
    return found.join(_largest(found), ["row", "col"]).select("row", "col", r("p", 4).alias("p"))


@query("SPA-21")
def active_contour_mask(s, d):
    """Seeds grown over weak gradients, and closed, up to twenty times; the largest components."""
    from terrane.operators.masks import active_contour

    return _largest(active_contour(_wave(s, d), (ROWS, COLS)))


@query("SPA-22")
def diffusion_cluster_mask(s, d):
    """The brightest of three clusters of smoothed value and place."""
    from terrane.operators.masks import diffusion_clusters

    return diffusion_clusters(S.gaussian(_wave(s, d), 1.4, (ROWS, COLS), "nearest"))


_PROTO = {
    "t": "select round(quantile_cont(v, .95), 6) hi, round(quantile_cont(v, .86), 6) lo from g",
    "pr": 'select avg(v) pv, avg("row" / 75.0::double) pr, avg(col / 100.0::double) pc from g, t where v >= hi',
    "sm": 'select "row", col, v, hi, lo, round(exp(-.5 * (pow(v - pv, 2) + pow(("row" / 75.0::double - pr) / .35, 2) + pow((col / 100.0::double - pc) / .35, 2))), 9) s from g, t, pr',
    "st": "select round(quantile_cont(s, .35), 9) q from sm where v >= lo",
}


@query("SPA-23", "pixel", 'select "row", col from sm, st where v >= hi or (v >= lo and s >= q)', LAT | _PROTO)
def prototype_mask(s, d):
    g = _wave(s, d)
    t = g.agg(F.round(F.percentile("v", F.lit(0.95)), 6).alias("hi"), F.round(F.percentile("v", F.lit(0.86)), 6).alias("lo"))
    at = g.crossJoin(F.broadcast(t)).withColumn("y", F.col("row") / 75.0).withColumn("x", F.col("col") / 100.0)
    proto = at.where("v >= hi").agg(F.avg("v").alias("pv"), F.avg("y").alias("pr"), F.avg("x").alias("pc"))
    sq = lambda c: F.pow(c, F.lit(2.0))
    sim = at.crossJoin(F.broadcast(proto)).withColumn("s", F.round(F.exp(-0.5 * (sq(F.col("v") - F.col("pv")) + sq((F.col("y") - F.col("pr")) / 0.35) + sq((F.col("x") - F.col("pc")) / 0.35))), 9))
    q = sim.where("v >= lo").agg(F.round(F.percentile("s", F.lit(0.35)), 9).alias("q"))
    return sim.crossJoin(F.broadcast(q)).where("v >= hi or (v >= lo and s >= q)").select("row", "col")


_GAUSS = {
    "kw": "select k, exp(-.5 * pow(k / 1.5::double, 2)) / (select sum(exp(-.5 * pow(k / 1.5::double, 2))) from (select unnest(range(-6, 7)) k)) w from (select unnest(range(-6, 7)) k)",
    "gr": 'select a."row" rr, a.col cc, sum(w * b.v) v from g a, kw, g b where b.col = a.col and b."row" = case when ((a."row" + k) % 152 + 152) % 152 < 76 then ((a."row" + k) % 152 + 152) % 152 else 151 - ((a."row" + k) % 152 + 152) % 152 end group by 1, 2',
    "gf": "select a.rr, a.cc, sum(w * b.v) v from gr a, kw, gr b where b.rr = a.rr and b.cc = case when ((a.cc + k) % 202 + 202) % 202 < 101 then ((a.cc + k) % 202 + 202) % 202 else 201 - ((a.cc + k) % 202 + 202) % 202 end group by 1, 2",
}


@query("SPA-24", "pixel", 'select rr "row", cc col, round(v, 5) + 0.0 v from gf', LAT | _GAUSS)
def gaussian_filter(s, d):
    return S.gaussian(_wave(s, d), 1.5, (ROWS, COLS)).select("row", "col", r("v", 5).alias("v"))


_SPARSE = {"px": 'select "row" rr, col cc from pixel where ("row" * 7 + col * 3) % 11 < 4 and "row" % 9 <> 4 and col between 6 and 95'}


@query("SPA-26", "pixel", """select r.r::int "row", round(case when p0 is null then lo1 when p1 is null then lo0 when p0 = p1 then lo else lo0 + (r.r - p0)::double / (p1 - p0) * (lo1 - lo0) end, 6) + 0.0 lo, round(case when p0 is null then hi1 when p1 is null then hi0 when p0 = p1 then hi else hi0 + (r.r - p0)::double / (p1 - p0) * (hi1 - hi0) end, 6) + 0.0 hi
from (select r, lo, hi, last_value(case when lo is not null then r end ignore nulls) over b p0, first_value(case when lo is not null then r end ignore nulls) over a p1, last_value(lo ignore nulls) over b lo0, first_value(lo ignore nulls) over a lo1, last_value(hi ignore nulls) over b hi0, first_value(hi ignore nulls) over a hi1
from (select unnest(range(76)) r) l left join (select rr, min(cc)::double lo, max(cc)::double hi from px group by rr) o on o.rr = l.r window b as (order by r rows between unbounded preceding and current row), a as (order by r rows between current row and unbounded following)) r""", _SPARSE)
def warp_bounds(s, d):
    px = A.pixels(s, d).where("(row * 7 + col * 3) % 11 < 4 and row % 9 <> 4 and col between 6 and 95")
    lines = s.range(ROWS).select(F.col("id").cast("int").alias("row"))
    return S.bounds(px, "col", "row", lines).select("row", r("lo").alias("lo"), r("hi").alias("hi"))


@query("SPA-27 SPA-28")
def resampled(s, d):
    """Values at the points of a grid over all observations, by weights in their Delaunay triangles; outside, the nearest one's."""
    o = A.observations(s, d)
    lim = o.agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    warped = o.crossJoin(F.broadcast(lim)).select(F.col("obs_id").alias("id"), ((F.col("x") - F.col("lx")) / (F.col("hx") - F.col("lx")) * 24).alias("x"), ((F.col("y") - F.col("ly")) / (F.col("hy") - F.col("ly")) * 18).alias("y"), "z")
    grid = A.lattice(s, 19, 25).select((F.col("row") * 25 + F.col("col")).cast("long").alias("place"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    weights = T.barycentric(grid, warped).join(warped.select("id", "z"), "id")
    return weights.groupBy(F.col("place").alias("pixel"), "inside").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("weight") * F.col("z"))).alias("v"))


@query("COR-10 SPA-32", "pixel", """select round((hc + vc) / 2, 6) + 0.0 spatial_neighbour_corr, round(greatest((hc + vc) / 2, 0) * 2, 6) + 0.0 proxy from (select covar_pop(v, rv) / (stddev_pop(v) * stddev_pop(rv)) hc from (select v, lead(v) over (partition by "row" order by col) rv from g) where rv is not null), (select covar_pop(v, dv) / (stddev_pop(v) * stddev_pop(dv)) vc from (select v, lead(v) over (partition by col order by "row") dv from g) where dv is not null)""", LAT)
def neighbour_correlation(s, d):
    g = _wave(s, d)
    right, down = (g.withColumn("o", F.lead("v").over(Window.partitionBy(a).orderBy(b))).where("o is not null").agg(*moments("v", "o")).select(correlation("null").alias(n)) for a, b, n in (("row", "col", "hc"), ("col", "row", "vc")))
    mean = (F.col("hc") + F.col("vc")) / 2
    return right.crossJoin(down).select(r(mean).alias("spatial_neighbour_corr"), r(F.greatest(mean, F.lit(0.0)) * 2).alias("proxy"))


@query("COR-12", "obs targets", "select gene, round(sum(z * lag) / sum(z * z), 6) + 0.0 moran from (select z.gene, z.obs_id, any_value(z.z) z, avg(n.z) lag from z join nn on nn.src = z.obs_id join z n on n.gene = z.gene and n.obs_id = nn.dst group by z.gene, z.obs_id) group by gene", {"nn": f"select src, dst from ({_KNN}) where rank <= 6", "z": "select gene, obs_id, y - avg(y) over (partition by gene) z from targets"})
def morans_i(s, d):
    edges = N.nearest_points(A.observations(s, d), 6, ["x", "y", "z"]).select("src", "dst")
    return S.moran(A.targets(s, d).withColumnRenamed("y", "v"), edges, ["gene"]).select("gene", r("moran").alias("moran"))


@query("SPA-33", "obs targets", "select gene, round(.5 * least(greatest(moran, 0) / .2, 1), 6) + 0.0 validated from (select gene, sum(z * lag) / sum(z * z) moran from (select z.gene, z.obs_id, any_value(z.z) z, avg(n.z) lag from z join nn on nn.src = z.obs_id join z n on n.gene = z.gene and n.obs_id = nn.dst group by z.gene, z.obs_id) group by gene)", {"nn": f"select src, dst from ({_KNN}) where rank <= 6", "z": "select gene, obs_id, y - avg(y) over (partition by gene) z from targets"})
def validated_score(s, d):
    edges = N.nearest_points(A.observations(s, d), 6, ["x", "y", "z"]).select("src", "dst")
    m = S.moran(A.targets(s, d).withColumnRenamed("y", "v"), edges, ["gene"])
    return m.select("gene", r(0.5 * F.least(F.greatest("moran", F.lit(0.0)) / 0.2, F.lit(1.0))).alias("validated"))


_ACT = {
    "pr": "select p.gene, p.enh, p.obs_id, o.x ox, o.y oy, o.z oz, p.x, p.y from paired p join obs o using (obs_id) where p.y > 0.08",
    "px": "select *, greatest(quantile_cont(case when x > 0 then x end, .99) over (partition by gene, enh), 1e-8) qx, greatest(quantile_cont(case when y > 0 then y end, .99) over (partition by gene, enh), 1e-8) qy from pr",
    "nm": "select gene, enh, obs_id, ox, oy, oz, least(greatest(x, 0), qx) / qx e, least(greatest(y, 0), qy) / qy c from px",
    "ft": "select gene, enh, case when stddev_pop(c) < 1e-8 then 0 else covar_pop(c, e) / var_pop(c) end sl, avg(e) me, avg(c) mc from nm group by gene, enh",
    "vw": "select gene, enh, obs_id, ox, oy, oz, abs(e - c) d, abs(log2((e + 1e-3) / (c + 1e-3))) l, e - (me - sl * mc + sl * c) rs from nm join ft using (gene, enh)",
    "lg": "select gene, enh, obs_id, ox, oy, oz, 1 w, round(d, 9) v, d raw from vw union all select gene, enh, obs_id, ox, oy, oz, 2, round(l, 9), l from vw union all select gene, enh, obs_id, ox, oy, oz, 3, round(abs(rs), 9), rs from vw",
    "ap": "select distinct gene, obs_id, ox, oy, oz from nm",
    "nn": "select gene, src, dst from (select a.gene, a.obs_id src, b.obs_id dst, row_number() over (partition by a.gene, a.obs_id order by round((a.ox - b.ox) * (a.ox - b.ox) + (a.oy - b.oy) * (a.oy - b.oy) + (a.oz - b.oz) * (a.oz - b.oz), 9), b.obs_id) k from ap a join ap b on a.gene = b.gene and a.obs_id <> b.obs_id) where k <= 6",
    "zz": "select gene, enh, w, obs_id, v - avg(v) over (partition by gene, enh, w) z from lg",
    "mo": "select gene, enh, w, sum(z * lag) / sum(z * z) m from (select a.gene, a.enh, a.w, a.obs_id, any_value(a.z) z, avg(b.z) lag from zz a join nn on nn.gene = a.gene and nn.src = a.obs_id join zz b on b.gene = a.gene and b.enh = a.enh and b.w = a.w and b.obs_id = nn.dst group by all) group by all",
    "tq": "select gene, enh, w, round(quantile_cont(v, .9), 9) t from lg group by all",
    "ht": "select lg.*, lg.obs_id id from lg join tq using (gene, enh, w) where v >= t",
    "hn": "select gene, enh, w, src, dst from (select a.gene, a.enh, a.w, a.obs_id src, b.obs_id dst, row_number() over (partition by a.gene, a.enh, a.w, a.obs_id order by round((a.ox - b.ox) * (a.ox - b.ox) + (a.oy - b.oy) * (a.oy - b.oy) + (a.oz - b.oz) * (a.oz - b.oz), 9), b.obs_id) k from ht a join ht b on a.gene = b.gene and a.enh = b.enh and a.w = b.w and a.obs_id <> b.obs_id) where k <= 6",
    "un": "select gene, enh, w, src, dst from hn union select gene, enh, w, dst, src from hn",
    "rc": "select gene, enh, w, obs_id id, obs_id lab from ht union select rc.gene, rc.enh, rc.w, rc.id, un.dst from rc join un on un.gene = rc.gene and un.enh = rc.enh and un.w = rc.w and un.src = rc.lab",
    "hs": "select gene, enh, w, max(k)::double / sum(k) frac from (select gene, enh, w, lab, count(*) k from (select gene, enh, w, id, min(lab) lab from rc group by all) group by all) group by all",
    "mg": "select gene, enh, w, case when w = 3 then stddev_pop(raw) else avg(abs(raw)) end size from lg group by gene, enh, w",
    "st": "select gene, enh, w, size * (1 + greatest(m, 0)) * frac s from mg join mo using (gene, enh, w) join hs using (gene, enh, w)",
}


@query("SPA-29 SPA-11 LIN-01", "paired obs", "select gene, enh, round(max(case when w = 1 then s end), 5) + 0.0 diff_structure, round(max(case when w = 2 then s end), 5) + 0.0 logfc_structure, round(max(case when w = 3 then s end), 5) + 0.0 residual_structure, round(.4 * max(case when w = 1 then s end) + .25 * max(case when w = 2 then s end) + .35 * max(case when w = 3 then s end), 5) + 0.0 total from st group by gene, enh", _ACT)
def structure_scores(s, d):
    """Difference, fold change and residual of each driver against its gene in the active part: size, autocorrelation, hot spots."""
    from terrane.operators.structure import packed_scores

    o = A.observations(s, d).select("obs_id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
    # As ``paired``: drivers that an array is too short for are 0, or the gene itself where they follow it.
    drivers = F.expr(f"transform(sequence(0, {A.VARS - A.FIRST_DRIVER - 1}), i -> struct(i as enh, coalesce(get(x, i), if(i % 4 = 1 and domain = (gene + i) % {A.DOMAINS}, y, 0D)) as x, y as y))")
    active = A.signals(s, d).where("y > 0.08").select("gene", "obs_id", drivers.alias("drivers")).join(o, "obs_id")
    return packed_scores(active)


_NET = {
    "mp": "select gene, enh, domain, greatest(x, 0) v, y from paired",
    "mean_all": "select gene, enh, avg(v) + 1e-8 total from mp group by all",
    "en": "select gene, enh, domain, round(least(greatest(avg(v) / any_value(total) - 1, -1), 1), 6) + 0.0 enrich from mp join mean_all using (gene, enh) group by all",
    "es": "select gene, enh, count_if(enrich > .05) hot, max(enrich) - min(enrich) sw from en group by all",
    "si": "select gene, enh, case when stddev_pop(v) = 0 or stddev_pop(y) = 0 then 0 else covar_pop(v, y) / (stddev_pop(v) * stddev_pop(y)) end s from mp group by all",
    "w1": "select obs_id, gene, enh, greatest(x, 0) v from paired",
    "pd": "select gene, avg(1 - (c + 1) / 2) pair_div from (select a.gene, a.enh, b.enh, case when stddev_pop(a.v) = 0 or stddev_pop(b.v) = 0 then 0 else covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) end c from w1 a join w1 b on a.gene = b.gene and a.obs_id = b.obs_id and a.enh < b.enh group by all) group by gene",
    "nt": "select gene, 1 - avg(((s + 1) / 2 + 1) / 2) breadth, avg((hot = 1)::int) specific, avg((hot >= 2)::int) shared, avg(sw) / 2 switching from si join es using (gene, enh) group by gene",
}


@query("SPA-31 SPA-30 COR-11", "paired", "select gene, round(pair_div, 6) + 0.0 pair_diversity, round(breadth, 6) + 0.0 breadth, round(specific, 6) + 0.0 specific_fraction, round(shared, 6) + 0.0 shared_fraction, round(switching, 6) + 0.0 switching, round(.35 * pair_div + .25 * breadth + .25 * specific + .15 * greatest(switching, 0), 6) + 0.0 complexity from nt join pd using (gene)", _NET)
def network_complexity(s, d):
    """Drivers' diversity, breadth and switching between domains. Similarities are mapped to [0, 1] twice, as published."""
    mp = A.paired(s, d).select("gene", "enh", "obs_id", "domain", F.greatest("x", F.lit(0.0)).alias("v"), "y")
    sim = mp.groupBy("gene", "enh").agg(*moments("v", "y"), (F.avg("v") + 1e-8).alias("total")).select("gene", "enh", "total", F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("cxy") / F.sqrt(F.col("vx") * F.col("vy"))).otherwise(0.0).alias("s"))
    means = mp.groupBy("gene", "enh", "domain").agg(F.avg("v").alias("m")).join(sim.select("gene", "enh", "total"), ["gene", "enh"])
    enrich = r(F.least(F.greatest(F.col("m") / F.col("total") - 1, F.lit(-1.0)), F.lit(1.0)))
    spread = means.select("gene", "enh", enrich.alias("e")).groupBy("gene", "enh").agg(F.count_if(F.col("e") > 0.05).alias("hot"), (F.max("e") - F.min("e")).alias("sw"))
    per_gene = sim.join(spread, ["gene", "enh"]).groupBy("gene").agg(
        (1 - F.avg(((F.col("s") + 1) / 2 + 1) / 2)).alias("breadth"), F.avg((F.col("hot") == 1).cast("int")).alias("specific"), F.avg((F.col("hot") >= 2).cast("int")).alias("shared"), (F.avg("sw") / 2).alias("switching")
    )

    def diversity(frame):
        """From the drivers' products, which rows give all at once."""
        g = frame["gram"].iloc[0]
        mean = g[0, 1:-1] / g[0, 0]
        cov = g[1:-1, 1:-1] / g[0, 0] - np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(cov), 0))
        both = np.outer(spread, spread)
        similar = np.where(both > 1e-12, cov / np.where(both > 1e-12, both, 1.0), 0.0)[np.triu_indices(len(mean), 1)]
        return [(int(frame["gene"].iloc[0]), float(np.mean(1 - (similar + 1) / 2)))]

    div = L.solve_groups(L.gram_rows(A.signals(s, d), ["gene"]), "gene", diversity, "gene int, pair_div double")
    full = per_gene.join(div, "gene")
    score = 0.35 * F.col("pair_div") + 0.25 * F.col("breadth") + 0.25 * F.col("specific") + 0.15 * F.greatest("switching", F.lit(0.0))
    return full.select("gene", r("pair_div").alias("pair_diversity"), r("breadth").alias("breadth"), r("specific").alias("specific_fraction"), r("shared").alias("shared_fraction"), r("switching").alias("switching"), r(score).alias("complexity"))


@query("SPA-34", "cells", "select var_id, place from (select var_id, row_number() over (order by round(var_pop(value), 9) desc, var_id) place from cells group by var_id) where place <= 2")
def top2_variance_projection(s, d):
    v = A.cells(s, d).groupBy("var_id").agg(F.round(F.var_pop("value"), 9).alias("v"))
    return v.withColumn("place", F.row_number().over(Window.orderBy(F.desc("v"), "var_id")).cast("long")).where("place <= 2").select("var_id", "place")


@query("SPA-34")
def principal_components(s, d):
    """The first fifteen components of the standardised features, and each one's share of their variance."""
    rows = A.table(s, d, "embeddings").select("vec_id", "embedding")
    mean, deviation, found, variances = C.components(rows, "embedding", 15)
    share = F.array(*[F.lit(float(v)) for v in variances / max((deviation > 1e-12).sum(), 1)])
    return C.projected(rows, "embedding", mean, deviation, found, "pc").withColumn("explained", share)


@query("SPA-02")
def kmeans_domains(s, d):
    """Six domains of the standardised coordinates, by the best of twenty starts."""
    o = A.observations(s, d).select("obs_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    scale = o.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = o.crossJoin(F.broadcast(scale)).select("obs_id", *[((F.col(c) - F.col(f"m_{c}")) / F.greatest(F.col(f"s_{c}"), F.lit(1e-8))).alias(c) for c in "xyz"])
    centres, _ = C.kmeans(z, ["x", "y", "z"], 6)
    return C.labelled(z, ["x", "y", "z"], centres, "domain").select("obs_id", "domain")


_PAIRED = LAT | {
    "mm": 'select "row", col, v a, round(cos("row" / 8.0::double) * sin(col / 12.0::double) * 8 + v / 2, 6) b from g',
    "qq": "select round(quantile_cont(a, .8), 6) ta, round(quantile_cont(b, .8), 6) tb, greatest(max(a), max(b)) - least(min(a), min(b)) span from mm",
    "gd": 'select (lead(a) over r - lag(a) over r) / 2 ax, (lead(b) over r - lag(b) over r) / 2 bx, (lead(a) over c - lag(a) over c) / 2 ay, (lead(b) over c - lag(b) over c) / 2 by_ from mm window r as (partition by "row" order by col), c as (partition by col order by "row")',
    "ss": "select round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) + 0.0 pearson, round((2 * avg(a) * avg(b) + pow(.01 * any_value(span), 2)) * (2 * covar_pop(a, b) + pow(.03 * any_value(span), 2)) / ((avg(a) * avg(a) + avg(b) * avg(b) + pow(.01 * any_value(span), 2)) * (var_pop(a) + var_pop(b) + pow(.03 * any_value(span), 2))), 6) + 0.0 ssim, round(2.0::double * count_if(a >= ta and b >= tb) / (count_if(a >= ta) + count_if(b >= tb)), 6) hotspot_dice from mm, qq",
}


@query("SPA-29 SPA-25", "pixel", "select ss.*, (select round(avg((ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_))), 6) + 0.0 from gd where ax is not null and ay is not null and ax * ax + ay * ay > 0 and bx * bx + by_ * by_ > 0) gradient_similarity from ss", _PAIRED)
def map_similarity(s, d):
    """Correlation, one-window SSIM, Dice of hot sets and mean cosine of gradients of two maps."""
    m = _wave(s, d).withColumnRenamed("v", "a").withColumn("b", r(F.cos(F.col("row") / 8.0) * F.sin(F.col("col") / 12.0) * 8 + F.col("a") / 2))
    q = m.agg(F.round(F.percentile("a", F.lit(0.8)), 6).alias("ta"), F.round(F.percentile("b", F.lit(0.8)), 6).alias("tb"), (F.greatest(F.max("a"), F.max("b")) - F.least(F.min("a"), F.min("b"))).alias("span"))
    c1, c2 = F.pow(0.01 * F.first("span"), F.lit(2.0)), F.pow(0.03 * F.first("span"), F.lit(2.0))
    ma, mb, cov = F.avg("a"), F.avg("b"), F.covar_pop("a", "b")
    ssim = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (F.var_pop("a") + F.var_pop("b") + c2))
    hot_a, hot_b = F.col("a") >= F.col("ta"), F.col("b") >= F.col("tb")
    whole = m.crossJoin(F.broadcast(q)).agg(
        r(cov / (F.stddev_pop("a") * F.stddev_pop("b"))).alias("pearson"), r(ssim).alias("ssim"), F.round(2.0 * F.count_if(hot_a & hot_b) / (F.count_if(hot_a) + F.count_if(hot_b)), 6).alias("hotspot_dice")
    )
    step = lambda c, w: (F.lead(c).over(w) - F.lag(c).over(w)) / 2
    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    slopes = m.select(step("a", across).alias("ax"), step("b", across).alias("bx"), step("a", down).alias("ay"), step("b", down).alias("by_"))
    size = lambda x, y: F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    live = slopes.where("ax is not null and ay is not null and ax * ax + ay * ay > 0 and bx * bx + by_ * by_ > 0")
    cosine = live.agg(r(F.avg((F.col("ax") * F.col("bx") + F.col("ay") * F.col("by_")) / (size("ax", "ay") * size("bx", "by_")))).alias("gradient_similarity"))
    return whole.crossJoin(F.broadcast(cosine))
