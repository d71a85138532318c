"""Queries: scans, projections, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.numeric import entropy, pick, r
from terrane.operators import intervals as I
from terrane.operators import neighbours as N
from terrane.operators import relational as R
from terrane.operators import sketches as K
from terrane.operators.lineage import cut
from terrane.operators.order import numbered, prefix_sums
from terrane.plans.registry import query
from terrane.sources import adapters as A
from terrane.sources import sparse as Z
from terrane.sources.layers import kept_layer
from terrane.sources.tables import scratch

T = A.table


# ---- scans and sinks ----
@query("SRC-02 SRC-03 SRC-04", "cells", "select var_id, list_position([40, 7, 12, 3], var_id) - 1 place, count(*) n, round(sum(value), 4) + 0.0 total from cells where var_id in (40, 7, 12, 3) group by all")
def read_features(s, d):
    return R.read_features(A.cells(s, d), [40, 7, 12, 3]).groupBy("var_id", "place").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"))


@query("SRC-02 REL-09 SET-05", "", "select v.id::int var_id from (select unnest([1, 2, 63, 64, 99]) id) v where v.id not in (select unnest(range(64)))")
def missing_features(s, d):
    asked = s.createDataFrame([(i,) for i in (1, 2, 63, 64, 99)], "var_id int")
    return R.missing_features(asked, A.cells(s, d), "var_id")


@query("SRC-06", "", "select event_id, props decoded from events")
def decode_bytes(s, d):
    return T(s, d, "events").select("event_id", F.decode(F.encode("props", "UTF-8"), "UTF-8").alias("decoded"))


@query("SRC-07 SNK-01 SNK-02", "links", "select target, count(*) n, round(sum(importance), 2) importance from links group by target")
def tsv_round_trip(s, d):
    from terrane.sources.tables import read_tsv, scratch, write_tsv

    path = f"{scratch(s)}/links"
    write_tsv(A.links(s, d), path, compression="gzip")
    back = read_tsv(s, path, "target string, region bigint, importance double, rho double, distance bigint")
    return back.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("importance"), 2).alias("importance"))


@query("SRC-08 TOP-01 SET-03 REL-08", "links", "select target, region, round(importance * abs(rho), 4) + 0.0 importance_x_abs_rho from (select *, row_number() over (partition by target order by importance * abs(rho) desc nulls last, region) k from links where target <> 'Brand#1' and region in (select s_suppkey from supplier where s_acctbal > 0)) where k <= 20")
def read_links(s, d):
    base = A.links(s, d).withColumn("importance_x_abs_rho", F.col("importance") * F.abs("rho"))
    known = base.select("target").where("target <> 'Brand#1'").distinct()
    regions = T(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("region")).distinct()
    return R.read_links(base, known, regions).select("target", "region", r("importance_x_abs_rho", 4).alias("importance_x_abs_rho"))


_GTF = {
    "ln": """select event_id line, case when event_id % 50 = 0 then '# comment' when event_id % 50 = 1 then 'short' || chr(9) || 'line' else concat_ws(chr(9), 'chr' || user_id, 'src', case when event_id % 2 = 0 then 'gene' else 'exon' end,
(event_id * 10)::varchar, (event_id * 10 + 500)::varchar, '.', case when event_id % 3 = 0 then '-' else '+' end, '.', 'gene_id "x"; gene_name "G' || (event_id % 97) || '";') end txt from events""",
    "f": "select line, string_split(txt, chr(9)) f from ln where not starts_with(txt, '#')",
    "rec": "select line, regexp_extract(f[9], 'gene_name \"([^\"]+)\"', 1) gene, f[1] chrom, f[4]::bigint \"start\", f[5]::bigint \"end\", f[7] strand, (case when f[7] = '-' then f[5] else f[4] end)::bigint tss from f where len(f) >= 9 and f[3] = 'gene'",
}


def _gtf_lines(s, d):
    e = T(s, d, "events")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("user_id")), F.lit("src"), F.when(F.col("event_id") % 2 == 0, "gene").otherwise("exon"), F.col("event_id") * 10, F.col("event_id") * 10 + 500, F.lit("."),
                       F.when(F.col("event_id") % 3 == 0, "-").otherwise("+"), F.lit("."), F.concat(F.lit('gene_id "x"; gene_name "G'), F.col("event_id") % 97, F.lit('";')))
    return e.select(F.col("event_id").alias("line"), F.when(F.col("event_id") % 50 == 0, "# comment").when(F.col("event_id") % 50 == 1, "short\tline").otherwise(line).alias("value"))


@query("SRC-09 STR-06", "", "select * exclude (k) from (select *, row_number() over (partition by gene order by line) k from rec) where k = 1", _GTF)
def gtf_genes(s, d):
    return R.first_records(R.parse_gtf(_gtf_lines(s, d)))


@query("SRC-10", "", "select * exclude (k) from (select *, row_number() over (partition by gene order by line desc) k from rec where gene = 'G42') where k = 1", _GTF)
def gtf_one_gene(s, d):
    return R.first_records(R.parse_gtf(_gtf_lines(s, d)).where("gene = 'G42'"), last=True)


@query("SRC-09", "", "select chrom, count(*) n, string_agg(tss::varchar, ',' order by tss) sites from (select distinct chrom, tss from rec) group by chrom", _GTF)
def gtf_sites(s, d):
    sites = R.parse_gtf(_gtf_lines(s, d)).select("chrom", "tss").distinct().groupBy("chrom").agg(F.sort_array(F.collect_list("tss")).alias("t"))
    return sites.select("chrom", F.size("t").cast("long").alias("n"), F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("sites"))


_CSV = {"l": "select vec_id, vec_id || '-5-9,' || array_to_string(list_transform(embedding[1:4], lambda x: round(x::double, 3)::varchar), ',') t from embeddings", "p": "select vec_id, string_split(t, ',') f from l"}


@query("SRC-11", "", "select f[1] interval_id, i - 1 obs, round(f[i + 1]::double, 3) + 0.0 as value from p, (select unnest(range(1, 5)) i) where len(f) - 1 = 4", _CSV)
def interval_vectors(s, d):
    e = T(s, d, "embeddings")
    line = F.concat(F.col("vec_id"), F.lit("-5-9,"), F.array_join(F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x.cast("double"), 3).cast("string")), ","))
    f = e.select(F.split(line, ",").alias("f")).where("size(f) - 1 = 4")
    return f.select(F.col("f")[0].alias("interval_id"), F.posexplode(F.slice("f", 2, 4)).alias("obs", "v")).select("interval_id", F.col("obs").cast("long").alias("obs"), r(F.col("v").cast("double"), 3).alias("value"))


@query("SRC-12", "", "select distinct x id from (select unnest(string_split('genes,' || string_agg(p_brand, ',') || ',,', ',')) x from part) where x <> '' and x <> 'genes'")
def interval_index(s, d):
    joined = T(s, d, "part").select("p_brand").distinct().agg(F.concat(F.lit("genes,"), F.array_join(F.collect_set("p_brand"), ","), F.lit(",,")).alias("t"))
    return joined.select(F.explode(F.split("t", ",")).alias("id")).where("id <> '' and id <> 'genes'").distinct()


@query("SRC-05 SRC-02", "cells", "select row_number() over (order by var_id, obs_id) - 1 \"at\", var_id col, obs_id \"row\", value from cells where value > 0")
def transposed_matrix(s, d):
    """The positive cells of the matrix: written by rows with row pointers, read back, and turned into columns with theirs."""
    path = scratch(s)
    size = A.cells(s, d).agg((F.max("obs_id") + 1).alias("n"), (F.max("var_id") + 1).alias("m")).first()
    Z.write_compressed(*Z.compress(A.cells(s, d).where("value > 0"), "obs_id", "var_id", "value"), path, (size.n, size.m))
    rows, entries, _ = Z.read_compressed(s, path)
    pointers, columns = Z.transpose(rows, entries)
    starts = pointers.select(F.col("row").alias("var"), "start", "stop")
    cells = Z.expand(pointers, columns, row="col", index="row", value="value").withColumn("place", F.row_number().over(Window.partitionBy("col").orderBy("row")) - 1)
    return cells.join(starts, F.col("col") == F.col("var")).select((F.col("start") + F.col("place")).alias("at"), F.col("col").cast("int").alias("col"), "row", "value")


@query("SRC-15 PRJ-03", "cells targets", "select c.var_id, count(*) n, round(sum(ln(1 + greatest(c.value, 0))), 4) + 0.0 total, round(sum(ln(1 + greatest(c.value, 0)) * t.y), 4) + 0.0 with_target from cells c join targets t on t.obs_id = c.obs_id and t.gene = 0 group by c.var_id")
def kept_log1p(s, d):
    """A kept layer of log1p values, asked for twice (built, then read), joined with a kept target by observation."""
    base = T(s, d, "embeddings")
    at = scratch(s)
    long = lambda f: f.select(F.col("vec_id").alias("obs_id"), F.posexplode("embedding").alias("var_id", "v")).select("obs_id", "var_id", F.log1p(F.greatest(F.col("v").cast("double"), F.lit(0.0))).alias("v"))
    for _ in range(2):
        layer, _built = kept_layer(base, long, f"{at}/log1p", ["obs_id"], 8)
    target, _built = kept_layer(base, lambda f: f.select(F.col("vec_id").alias("obs_id"), F.greatest(F.get("embedding", F.lit(A.FIRST_GENE)).cast("double"), F.lit(0.0)).alias("y")), f"{at}/target", ["obs_id"], 8)
    return layer.join(target, "obs_id").groupBy("var_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("v"), 4).alias("total"), r(F.sum(F.col("v") * F.col("y")), 4).alias("with_target"))


@query("PRJ-03", "cells", "select var_id, round(sum(ln(1 + greatest(value, 0))), 4) + 0.0 total from cells group by var_id")
def log1p_layer(s, d):
    return A.cells(s, d).withColumn("v", F.log1p(F.greatest("value", F.lit(0.0)))).groupBy("var_id").agg(r(F.sum("v"), 4).alias("total"))


@query("SRC-17", "cells obs", "select (select count(*) from obs) n_obs, (select count(distinct var_id) from cells) n_vars, true has_spatial, (select count_if(x is not null and y is not null and not isnan(x) and not isnan(y)) from obs) n_valid")
def audit_dataset(s, d):
    o = A.observations(s, d)
    n = A.cells(s, d).agg(F.countDistinct("var_id").alias("n_vars"))
    got = o.agg(F.count(F.lit(1)).alias("n_obs"), F.count_if(F.expr("x is not null and y is not null and not isnan(x) and not isnan(y)")).alias("n_valid"))
    return got.crossJoin(F.broadcast(n)).select("n_obs", "n_vars", F.lit({"x", "y"} <= set(o.columns)).alias("has_spatial"), "n_valid")


@query("SRC-18", "cells", "select source, count(*) n, round(coalesce(sum(value), 0), 4) + 0.0 total from (select coalesce(m.value, i.value) as value, case when m.value is not null then 'measured' when i.value is not null then 'imputed' else 'missing' end source from cells w left join (select obs_id, var_id, value from cells where value > .5) m using (obs_id, var_id) left join (select obs_id, var_id, value / 2 as value from cells where value > -.5) i using (obs_id, var_id)) group by source")
def layer_fallback(s, d):
    """Measured cells are the high ones, imputed ones all but the lowest; all cells are asked for."""
    c = A.cells(s, d)
    imputed = c.where("value > -0.5").select("obs_id", "var_id", (F.col("value") / 2).alias("value"))
    got = R.layered(c.where("value > 0.5"), imputed, c.select("obs_id", "var_id"), ["obs_id", "var_id"], "value")
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n"), r(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"))


@query("SNK-08", "", "select p_partkey id from part where not (p_partkey % 3 = 0 or p_partkey % 5 = 0)")
def pending_ledger(s, d):
    wanted = T(s, d, "part").select(F.col("p_partkey").alias("id"))
    done = wanted.withColumn("status", F.when(F.col("id") % 3 == 0, "readable").when(F.col("id") % 5 == 0, "blocked").otherwise("error"))
    return R.pending(wanted, done, "id")


@query("SNK-11", "obs cells links", "select 'obs' part, count(*) n from obs union all select 'enhancers', count(distinct var_id) from cells where var_id >= 11 union all select 'genes', count(distinct var_id) from cells where var_id between 3 and 10 union all select 'links', count(*) from links")
def paired_inputs(s, d):
    c = A.cells(s, d)
    parts = {"obs": A.observations(s, d), "enhancers": c.where("var_id >= 11").select("var_id").distinct(), "genes": c.where("var_id between 3 and 10").select("var_id").distinct(), "links": A.links(s, d)}
    out = None
    for name, frame in parts.items():
        row = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# ---- projections ----
@query("PRJ-01 REL-01", "obs cells", "select o.obs_id, round(o.x, 6) + 0.0 x, round(o.y, 6) + 0.0 y from obs o join (select distinct obs_id from cells where value > 0.2) c using (obs_id) where not isnan(o.x) and o.x between -0.1 and 0.1 and o.y between -0.1 and 0.1")
def paired_observations(s, d):
    o, c = A.observations(s, d), A.cells(s, d).where("value > 0.2").select("obs_id").distinct()
    return o.where("not isnan(x) and x between -0.1 and 0.1 and y between -0.1 and 0.1").join(c, "obs_id", "left_semi").select("obs_id", r("x").alias("x"), r("y").alias("y"))


@query("PRJ-02", "pixel", 'select "row", col, round(value, 6) + 0.0 as value from pixel where "row" between 10 and 20 and col between 5 and 40')
def rectangle(s, d):
    return A.pixels(s, d).where("row between 10 and 20 and col between 5 and 40").select("row", "col", r("value").alias("value"))


@query("PRJ-04", "cells", "select var_id, obs_id, round((value - min(value) over (partition by var_id)) / greatest(max(value) over (partition by var_id) - min(value) over (partition by var_id), 1e-8), 6) + 0.0 v from cells")
def normalise(s, d):
    w = Window.partitionBy("var_id")
    return A.cells(s, d).select("var_id", "obs_id", r((F.col("value") - F.min("value").over(w)) / F.greatest(F.max("value").over(w) - F.min("value").over(w), F.lit(1e-8))).alias("v"))


_P99 = {"p": "select var_id, greatest(quantile_cont(case when value > 0 then value end, .99), 1e-8) p from cells group by var_id"}


def p99(frame, by, value="value"):
    """by, p: the 99th percentile of positive values, floored; null without positives."""
    return frame.groupBy(*by).agg(F.greatest(F.percentile(F.when(F.col(value) > 0, F.col(value)), F.lit(0.99)), F.lit(1e-8)).alias("p"))


@query("PRJ-05", "cells", "select var_id, obs_id, round(coalesce(least(greatest(value, 0), p) / p, 0), 6) + 0.0 v from cells join p using (var_id)", _P99)
def p99_normalise(s, d):
    c = A.cells(s, d)
    return c.join(p99(c, ["var_id"]), "var_id").select("var_id", "obs_id", r(F.coalesce(F.least(F.greatest("value", F.lit(0.0)), "p") / F.col("p"), F.lit(0.0))).alias("v"))


@query("PRJ-06", "pixel", 'select "row", col, round(least(greatest((value - q.lo) / (q.hi - q.lo + 1e-8), 0), 1), 6) + 0.0 v from pixel, (select quantile_cont(value, .02) lo, quantile_cont(value, .98) hi from pixel) q')
def robust_scale(s, d):
    p = A.pixels(s, d)
    q = p.agg(F.percentile("value", F.lit(0.02)).alias("lo"), F.percentile("value", F.lit(0.98)).alias("hi"))
    return p.crossJoin(F.broadcast(q)).select("row", "col", r(F.least(F.greatest((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8), F.lit(0.0)), F.lit(1.0))).alias("v"))


@query("PRJ-07 PRJ-08", "obs", "select obs_id, round((x - avg(x) over ()) / greatest(stddev_pop(x) over (), 1e-8), 6) + 0.0 zx, round((y - avg(y) over ()) / greatest(stddev_pop(y) over (), 1e-8), 6) + 0.0 zy, round(least((x - min(x) over ()) / greatest(max(x) over () - min(x) over (), 1e-8), 0.9999999999999999), 6) + 0.0 ux from obs")
def standardise(s, d):
    o = A.observations(s, d)
    m = o.agg(*[F.avg(c).alias(f"m{c}") for c in "xy"], *[F.stddev_pop(c).alias(f"s{c}") for c in "xy"], F.min("x").alias("lo"), F.max("x").alias("hi"))
    z = lambda c: r((F.col(c) - F.col(f"m{c}")) / F.greatest(f"s{c}", F.lit(1e-8))).alias(f"z{c}")
    return o.crossJoin(F.broadcast(m)).select("obs_id", z("x"), z("y"), r(F.least((F.col("x") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8)), F.lit(0.9999999999999999))).alias("ux"))


@query("PRJ-09", "cells", "select var_id, round(coalesce(quantile_cont(case when value > 0 then value end, .995), 1.0), 6) + 0.0 vmax from cells group by var_id")
def robust_vmax(s, d):
    return A.cells(s, d).groupBy("var_id").agg(r(F.coalesce(F.percentile(F.when(F.col("value") > 0, F.col("value")), F.lit(0.995)), F.lit(1.0))).alias("vmax"))


@query("PRJ-10 AGG-03", "links", "select target, region, importance, rho, distance from (select *, count(*) over (partition by target) n from links where rho is not null and importance is not null and importance > 0 and abs(rho) >= .05 and target <> 'Brand#3') where n >= 5")
def filter_links(s, d):
    base = A.links(s, d)
    return R.filter_links(base, base.select("target").where("target <> 'Brand#3'").distinct()).select("target", "region", "importance", "rho", "distance")


@query("PRJ-11", "links", "select target, region, rho from links where rho >= 0 and round(rho * .9, 6) >= .1")
def rho_gate(s, d):
    return A.links(s, d).where("rho >= 0 and round(rho * 0.9, 6) >= 0.1").select("target", "region", "rho")


@query("PRJ-13 PRJ-14 PRJ-15", "targets cells", "select t.obs_id, round(greatest(c.value, 0) * (t.y > 0.1)::int, 6) + 0.0 latent, round(log2((t.y + 1e-3) / (greatest(c.value, 0) + 1e-3)), 6) + 0.0 logfc from targets t join cells c on c.obs_id = t.obs_id and c.var_id = 20 where t.gene = 2")
def latent_and_logfc(s, d):
    t, c = A.targets(s, d).where("gene = 2"), A.cells(s, d).where("var_id = 20").select("obs_id", "value")
    v = F.greatest("value", F.lit(0.0))
    return t.join(c, "obs_id").select("obs_id", r(v * (F.col("y") > 0.1).cast("int")).alias("latent"), r(F.log2((F.col("y") + 1e-3) / (v + 1e-3))).alias("logfc"))


@query("PRJ-16 TOP-03", "", "select k, p_partkey from (select row_number() over (order by p_retailprice desc, p_partkey) k, p_partkey from part) where k between 11 and 40")
def rank_range(s, d):
    placed = numbered(T(s, d, "part").select("p_retailprice", "p_partkey"), [F.desc("p_retailprice"), F.col("p_partkey")], "k")
    return placed.where("k between 11 and 40").select("k", "p_partkey")


@query("PRJ-17", "targets obs", "select t.obs_id, t.gene, case when o.domain <> 2 then round(t.y, 6) + 0.0 else 0.0 end context, (o.domain <> 2)::int visible from targets t join obs o using (obs_id)")
def heldout_context(s, d):
    j = A.targets(s, d).join(A.observations(s, d).select("obs_id", "domain"), "obs_id")
    seen = F.col("domain") != 2
    return j.select("obs_id", "gene", F.when(seen, r("y")).otherwise(0.0).alias("context"), seen.cast("int").alias("visible"))


@query("PRJ-19 AGG-18", "links", "select target, round(sum(importance * rho), 2) + 0.0 signed_sum, round(sum(importance * abs(rho)), 2) + 0.0 abs_sum, round(sum(case when rho >= .1 then importance else 0 end) / greatest(sum(importance), 1e-8), 6) + 0.0 retained from links group by target")
def link_products(s, d):
    return A.links(s, d).groupBy("target").agg(
        r(F.sum(F.col("importance") * F.col("rho")), 2).alias("signed_sum"), r(F.sum(F.col("importance") * F.abs("rho")), 2).alias("abs_sum"),
        r(F.sum(F.when(F.col("rho") >= 0.1, F.col("importance")).otherwise(0.0)) / F.greatest(F.sum("importance"), F.lit(1e-8))).alias("retained"),
    )


# ---- strings ----
_IV = {"iv": "select event_id, case when event_id % 5 = 0 then 'chr' || user_id || ':' || event_id || '-' || (event_id + 501) when event_id % 5 = 1 then user_id || '-' || event_id || '-' || (event_id + 501) else event_type end t from events"}


def _intervals(s, d):
    e = T(s, d, "events")
    t = F.when(F.col("event_id") % 5 == 0, F.format_string("chr%d:%d-%d", "user_id", "event_id", F.col("event_id") + 501)).when(F.col("event_id") % 5 == 1, F.format_string("%d-%d-%d", "user_id", "event_id", F.col("event_id") + 501)).otherwise(F.col("event_type"))
    return e.select("event_id", t.alias("t"))


@query("STR-01 STR-02 STR-03 STR-07", "", """select event_id, regexp_extract(t, p, 1) chrom, regexp_extract(t, p, 2)::bigint "start", regexp_extract(t, p, 3)::bigint "end", 501::bigint width, (regexp_extract(t, p, 2)::bigint + regexp_extract(t, p, 3)::bigint) // 2 center,
regexp_extract(t, p, 1) || ':' || regexp_extract(t, p, 2) || '-' || regexp_extract(t, p, 3) region from iv, (select '^([^:\\-]+)[:\\-](\\d+)-(\\d+)$' p) where regexp_matches(t, p)""", _IV)
def parse_intervals(s, d):
    got = _intervals(s, d).select("event_id", R.parse_interval(F.col("t")).alias("i")).where("i is not null").select("event_id", "i.*")
    return got.withColumn("region", F.format_string("%s:%d-%d", "chrom", "start", "end"))


@query("STR-04", "", "select event_id, (event_id + event_id + 501) / 2.0::double mid from iv where event_id % 5 = 0", _IV)
def strict_intervals(s, d):
    got = _intervals(s, d).where("event_id % 5 = 0").select("event_id", R.parse_interval(F.col("t"), strict=True).alias("i"))
    return got.select("event_id", ((F.col("i.start") + F.col("i.end")) / 2.0).alias("mid"))


@query("STR-05 STR-14", "", "select event_id, t stem from iv where event_id % 5 = 1 and len(string_split(t, '-')) = 3 and string_split(t, '-')[1] = '7'", _IV)
def window_intervals(s, d):
    f = _intervals(s, d).where(F.col("t").rlike(r"^(\d+)-(\d+)-(\d+)$")).withColumn("f", F.split("t", "-"))
    return f.where("size(f) = 3 and f[0] = '7'").select("event_id", F.col("t").alias("stem"))


@query("STR-10 STR-12", "", "select format('h_r{:02d}_c{:03d}', r, c) as name, upper('gene' || c) as upper_name from (select unnest(range(76)) r), (select unnest(range(101)) c)")
def grid_names(s, d):
    return A.lattice(s).select(F.format_string("h_r%02d_c%03d", "row", "col").alias("name"), F.upper(F.concat(F.lit("gene"), F.col("col"))).alias("upper_name"))


@query("STR-11 STR-13", "obs", "select '[' || string_agg(n::varchar, ',' order by domain) || ']' as json, string_agg(n::varchar, ',' order by domain) as joined from (select domain, count(*) n from obs group by domain)")
def encode_sizes(s, d):
    sizes = A.observations(s, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    ordered = sizes.agg(F.transform(F.sort_array(F.collect_list(F.struct("domain", "n"))), lambda x: x["n"]).alias("a"))
    return ordered.select(F.to_json("a").alias("json"), F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("joined"))


@query("STR-06", "", "select event_id, (props->>'$.k')::bigint k from events")
def json_field(s, d):
    return T(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# ---- joins ----
@query("REL-02", "links", "select l.target, l.region, l.importance, p.n from links l join (select p_brand target, count(*) n from part group by all) p using (target) where l.region = 5")
def equi_join(s, d):
    n = T(s, d, "part").groupBy(F.col("p_brand").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return A.links(s, d).where("region = 5").join(n, "target").select("target", "region", "importance", "n")


@query("REL-05 WIN-01", "links", "select target, n, case when n >= 100 then row_number() over (partition by n >= 100 order by score desc, target) end eligible_rank from (select target, count(*) n, round(sum(importance * abs(rho)), 2) score from links group by target)")
def eligible_rank(s, d):
    g = A.links(s, d).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("importance") * F.abs("rho")), 2).alias("score"))
    ok = F.col("n") >= 100
    place = F.row_number().over(Window.partitionBy(ok).orderBy(F.desc("score"), "target"))
    return g.select("target", "n", F.when(ok, place).cast("long").alias("eligible_rank"))


@query("REL-06", "peak", "select p.peak, p.signal, n.n_name label from peak p left join nation n on n.n_nationkey = p.chrom")
def left_join_scores(s, d):
    return A.peaks(s, d).join(T(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("chrom"), F.col("n_name").alias("label")), "chrom", "left").select("peak", "signal", "label")


@query("REL-07", "gene peak", "select coalesce(g.chrom, p.chrom) chrom, g.n genes, p.n peaks from (select chrom, count(*) n from gene where chrom % 2 = 0 group by 1) g full join (select chrom, count(*) n from peak where chrom % 3 = 0 group by 1) p on g.chrom = p.chrom")
def full_outer(s, d):
    g = A.genes(s, d).where("chrom % 2 = 0").groupBy("chrom").agg(F.count(F.lit(1)).alias("genes"))
    p = A.peaks(s, d).where("chrom % 3 = 0").groupBy("chrom").agg(F.count(F.lit(1)).alias("peaks"))
    return g.join(p, "chrom", "full_outer").select("chrom", "genes", "peaks")


@query("REL-10", "links", "select a.target, a.region, a.importance, b.rho prior from links a left join (select * from links where rho > 0) b using (target, region)")
def prior_lookup(s, d):
    base = A.links(s, d)
    prior = base.where("rho > 0").select("target", "region", F.col("rho").alias("prior"))
    return base.select("target", "region", "importance").join(prior, ["target", "region"], "left")


@query("REL-11 SET-04", "gene peak", "select gene, peak, center - tss offset_ from gene g join peak p on g.chrom = p.chrom and abs(center - tss) <= 86400")
def peaks_in_reach(s, d):
    return N.range_join(A.genes(s, d), A.peaks(s, d), ["chrom"], "tss", "center", 86400).select("gene", "peak", (F.col("center") - F.col("tss")).alias("offset_"))


@query("REL-12", "gene", "select a.gene, b.gene neighbour, b.tss - a.tss offset_ from gene a join gene b on a.chrom = b.chrom and a.gene <> b.gene and abs(a.tss - b.tss) <= 43200")
def neighbour_genes(s, d):
    g = A.genes(s, d)
    other = g.select(F.col("gene").alias("neighbour"), "chrom", F.col("tss").alias("there"))
    return N.range_join(g, other, ["chrom"], "tss", "there", 43200).where("gene <> neighbour").select("gene", "neighbour", (F.col("there") - F.col("tss")).alias("offset_"))


@query("REL-13", "gene peak", "select peak from peak p where not exists (select 1 from gene g where g.chrom = p.chrom and abs(p.center - g.tss) <= 7200)")
def distal_peaks(s, d):
    return N.range_anti_join(A.peaks(s, d), A.genes(s, d), ["chrom"], "center", "tss", 7200).select("peak")


@query("REL-14", "paired", "select a.gene, a.enh i, b.enh j, round(a.m - b.m, 6) + 0.0 diff from m a join m b on a.gene = b.gene and a.enh < b.enh", {"m": "select gene, enh, avg(x) m from paired group by all"})
def pairs_in_group(s, d):
    """All pairs of a gene's drivers, by their means; a group has a row a driver."""
    base = A.paired(s, d).groupBy("gene", "enh").agg(F.avg("x").alias("m"))
    other = base.select("gene", F.col("enh").alias("j"), F.col("m").alias("m_j"))
    return base.join(other, "gene").where("enh < j").select("gene", F.col("enh").alias("i"), "j", r(F.col("m") - F.col("m_j")).alias("diff"))


@query("REL-15", "obs", "select src, dst, rank from (select a.obs_id src, b.obs_id dst, row_number() over (partition by a.obs_id order by round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 9), b.obs_id) rank from obs a join obs b on a.obs_id <> b.obs_id) where rank <= 6")
def nearest_neighbours(s, d):
    return N.nearest_points(A.observations(s, d), 6, ["x", "y", "z"]).select("src", "dst", F.col("rank").cast("long").alias("rank"))


@query("REL-19 SPA-28", "cells", "select t.obs_id, round(sum(w * value), 6) + 0.0 v from (select obs_id, (obs_id + k) % (select count(*) from embeddings) src, [.5, .3, .2][k + 1] w from (select vec_id obs_id from embeddings), (select unnest([0, 1, 2]) k)) t join cells c on c.obs_id = t.src and c.var_id = 9 group by t.obs_id")
def weighted_gather(s, d):
    n = A.observations(s, d).agg(F.count(F.lit(1)).alias("n"))
    ids = A.observations(s, d).select("obs_id").crossJoin(F.broadcast(n))
    weights = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate((0.5, 0.3, 0.2))]))
    taps = ids.select("obs_id", "n", weights.alias("t")).select("obs_id", ((F.col("obs_id") + F.col("t.k")) % F.col("n")).alias("src"), F.col("t.w").alias("w"))
    source = A.cells(s, d).where("var_id = 9").select(F.col("obs_id").alias("src"), "value")
    return taps.join(source, "src").groupBy("obs_id").agg(r(F.sum(F.col("w") * F.col("value"))).alias("v"))


# ---- aggregates ----
@query("AGG-01", "links", "select target, round(sum(importance::decimal(18, 2)), 0)::double total, row_number() over (order by round(sum(importance::decimal(18, 2)), 0) desc, target) place from links group by target")
def target_order(s, d):
    g = A.links(s, d).groupBy("target").agg(F.round(F.sum(F.col("importance").cast("decimal(18,2)")), 0).cast("double").alias("total"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "target")).cast("long"))


@query("AGG-02", "", "select p_brand target, count(distinct l_suppkey) regions from lineitem join part on l_partkey = p_partkey group by 1")
def distinct_regions(s, d):
    return T(s, d, "lineitem").join(T(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("target")).agg(F.countDistinct("l_suppkey").alias("regions"))


@query("AGG-04", "links", "select count(*) n, round(avg(rho), 6) + 0.0 mean, round(stddev_samp(rho), 6) + 0.0 std, min(rho) lo, round(quantile_cont(rho, .25), 6) + 0.0 q25, round(quantile_cont(rho, .5), 6) + 0.0 q50, round(quantile_cont(rho, .75), 6) + 0.0 q75, max(rho) hi from links")
def describe(s, d):
    q = lambda p, n: r(F.percentile("rho", F.lit(p))).alias(n)
    return A.links(s, d).agg(F.count(F.lit(1)).alias("n"), r(F.avg("rho")).alias("mean"), r(F.stddev_samp("rho")).alias("std"), F.min("rho").alias("lo"), q(0.25, "q25"), q(0.5, "q50"), q(0.75, "q75"), F.max("rho").alias("hi"))


_GD = {
    "sc": "select target gene, round(abs(rho) * 0.7310585::double, 9) score from links where rho is not null",
    "th": "select round(quantile_cont(score, .9), 9) t from sc",
    "top": "select gene, avg(score) top3 from (select *, row_number() over (partition by gene order by score desc) k from sc) where k <= 3 group by gene",
    "g": "select gene, count(*) n, quantile_cont(score, .5) med, avg(score) mean, max(score) mx, stddev_pop(score) sd, avg((score >= (select t from th))::int) frac from sc group by gene",
}


def gene_scores(s, d):
    return A.links(s, d).where("rho is not null").select(F.col("target").alias("gene"), F.round(F.abs("rho") * 0.7310585, 9).alias("score"))


def summarise_genes(scores):
    """gene, n, med, mean, mx, sd, top3 of scores."""
    placed = scores.withColumn("k", pick([F.desc("score")], ["gene"]))
    return placed.groupBy("gene").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("score", F.lit(0.5)).alias("med"), F.avg("score").alias("mean"), F.max("score").alias("mx"), F.stddev_pop("score").alias("sd"), F.avg(F.when(F.col("k") <= 3, F.col("score"))).alias("top3")
    )


@query("AGG-10 AGG-12 WIN-08", "links", "select gene, n, round(med, 10) + 0.0 med, round(mean, 6) + 0.0 mean, round(mx, 6) + 0.0 mx, round(sd, 6) + 0.0 sd, round(top3, 6) + 0.0 top3, round(frac, 6) + 0.0 frac, round(.4 * med + .35 * frac + .25 * top3, 6) + 0.0 divergence from g join top using (gene)", _GD)
def gene_divergence_relative(s, d):
    sc = gene_scores(s, d)
    limit = sc.agg(F.round(F.percentile("score", F.lit(0.9)), 9).alias("t"))
    frac = sc.crossJoin(F.broadcast(limit)).groupBy("gene").agg(F.avg((F.col("score") >= F.col("t")).cast("int")).alias("frac"))
    full = summarise_genes(sc).join(frac, "gene")
    return full.select("gene", "n", r("med", 10).alias("med"), *[r(c).alias(c) for c in ("mean", "mx", "sd", "top3", "frac")], r(0.4 * F.col("med") + 0.35 * F.col("frac") + 0.25 * F.col("top3")).alias("divergence"))


@query("AGG-11", "links", "select gene, round(.6 * med + .4 * top3, 6) + 0.0 absolute_divergence, row_number() over (order by round(.6 * med + .4 * top3, 6) desc, gene) absolute_rank from g join top using (gene)", _GD)
def gene_divergence_absolute(s, d):
    g = summarise_genes(gene_scores(s, d)).select("gene", r(0.6 * F.col("med") + 0.4 * F.col("top3")).alias("absolute_divergence"))
    return g.withColumn("absolute_rank", F.row_number().over(Window.orderBy(F.desc("absolute_divergence"), "gene")).cast("long"))


@query("AGG-13 FIG-06", "links", "select bin, count(*) n, any_value(q90) q90, any_value(q99) q99 from (select least(floor(score / mx * 70), 69)::int bin, q90, q99 from sc, (select max(score) mx, round(quantile_cont(score, .9), 6) + 0.0 q90, round(quantile_cont(score, .99), 6) + 0.0 q99 from sc)) group by bin", {"sc": _GD["sc"]})
def score_histogram(s, d):
    sc = gene_scores(s, d)
    q = sc.agg(F.max("score").alias("mx"), r(F.percentile("score", F.lit(0.9))).alias("q90"), r(F.percentile("score", F.lit(0.99))).alias("q99"))
    binned = sc.crossJoin(F.broadcast(q)).withColumn("bin", F.least(F.floor(F.col("score") / F.col("mx") * 70), F.lit(69)).cast("int"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.first("q90").alias("q90"), F.first("q99").alias("q99"))


@query("AGG-14 FIG-08", "cells", "select var_id, count_if(value > 0.1) nonzero, round(avg((value > 0.1)::int), 6) + 0.0 fraction, round(sum(greatest(value, 0)), 4) + 0.0 total from cells group by var_id")
def peak_stats(s, d):
    hot = F.col("value") > 0.1
    return A.cells(s, d).groupBy("var_id").agg(F.count_if(hot).alias("nonzero"), r(F.avg(hot.cast("int"))).alias("fraction"), r(F.sum(F.greatest("value", F.lit(0.0))), 4).alias("total"))


@query("AGG-15 FIG-03 SPA-01", "obs", "select domain, count(*) n, round(count(*)::double / (select count(*) from obs), 6) + 0.0 fraction, round(quantile_cont(x, .5), 6) + 0.0 mx, round(quantile_cont(y, .5), 6) + 0.0 my from obs group by domain")
def domain_sizes(s, d):
    g = A.observations(s, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), r(F.percentile("x", F.lit(0.5))).alias("mx"), r(F.percentile("y", F.lit(0.5))).alias("my"))
    return g.select("domain", "n", r(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("fraction"), "mx", "my")


_SPEC = {"sp": "select region, round(max(rho) - min(rho), 6) + 0.0 specificity from links where rho is not null group by region", "md": "select *, specificity >= .2 specific from sp"}


@query("AGG-16", "links", "select * from sp", _SPEC)
def specificity(s, d):
    return A.links(s, d).where("rho is not null").groupBy("region").agg(r(F.max("rho") - F.min("rho")).alias("specificity"))


@query("FIG-09 TOP-05 SET-02", "links", "select region, specificity, specific from (select *, row_number() over (order by specific desc, specificity desc, region) k from md) where k <= 15", _SPEC)
def prefer_specific(s, d):
    sp = A.links(s, d).where("rho is not null").groupBy("region").agg(r(F.max("rho") - F.min("rho")).alias("specificity")).withColumn("specific", F.col("specificity") >= 0.2)
    return sp.orderBy(F.desc("specific"), F.desc("specificity"), "region").limit(15)


@query("AGG-17", "links", "select target, coalesce(max(case when region = 1 then rho end), 0) r1, coalesce(max(case when region = 2 then rho end), 0) r2, coalesce(max(case when region = 3 then rho end), 0) r3 from links where region <= 3 and region >= 1 group by target")
def pivot_links(s, d):
    wide = A.links(s, d).where("region between 1 and 3").groupBy("target").pivot("region", [1, 2, 3]).agg(F.max("rho"))
    return wide.select("target", *[F.coalesce(F.col(f"`{k}`"), F.lit(0.0)).alias(f"r{k}") for k in (1, 2, 3)])


@query("AGG-19", "cells", "select var_id, round(-sum(p * ln(p)) / ln(32), 6) + 0.0 entropy from (select var_id, count(*)::double / sum(count(*)) over (partition by var_id) p from (select var_id, least(floor(least(greatest(value + .5, 0), 1) * 32), 31) b from cells) group by var_id, b) group by var_id")
def histogram_entropy(s, d):
    v = F.least(F.greatest(F.col("value") + 0.5, F.lit(0.0)), F.lit(1.0))
    counts = A.cells(s, d).groupBy("var_id", F.least(F.floor(v * 32), F.lit(31)).alias("b")).agg(F.count(F.lit(1)).alias("k"))
    total = F.sum("k")
    return counts.groupBy("var_id").agg(r((F.log(total.cast("double")) - F.sum(F.col("k") * F.log(F.col("k").cast("double"))) / total) / F.log(F.lit(32.0))).alias("entropy"))


# ---- windows, order, sets ----
@query("WIN-03 FIG-04", "links", "select target, region, dense_rank() over (partition by target order by rho desc nulls last) high, dense_rank() over (partition by target order by rho asc nulls last) low from links")
def dense_ranks(s, d):
    w = Window.partitionBy("target")
    return A.links(s, d).select("target", "region", F.dense_rank().over(w.orderBy(F.desc_nulls_last("rho"))).cast("long").alias("high"), F.dense_rank().over(w.orderBy(F.asc_nulls_last("rho"))).cast("long").alias("low"))


_BH = {"pv": "select c_nationkey g, c_custkey id, round((c_acctbal + 1000) / 12000, 2) p from customer", "b": "select *, p * count(*) over (partition by g) / row_number() over (partition by g order by p) b from pv"}


@query("WIN-04", "", "select g, id, round(least(1.0::double, min(b) over (partition by g order by p range between current row and unbounded following)), 6) + 0.0 q from b", _BH)
def q_values(s, d):
    from terrane.functions.numeric import with_q_values

    p = T(s, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), F.round((F.col("c_acctbal") + 1000) / 12000, 2).alias("p"))
    return with_q_values(p, "p", ["g"], "q").select("g", "id", r("q").alias("q"))


_FOLD = {"o": "select obs_id, round(x, 2) c from obs", "l": "select *, least((row_number() over (order by c, obs_id) - 1) * 5 // count(*) over (), 4) f from o", "m": "select obs_id, min(f) over (partition by c) f from l", "fd": "select obs_id, dense_rank() over (order by f) - 1 fold from m"}


def folds(s, d, k=5):
    """obs_id, fold: contiguous slabs of x with about as many observations each; equal coordinates stay together.

    Counts per coordinate are cumulated by blocks, so no task sees all coordinates.
    """
    o = A.observations(s, d).select("obs_id", F.round(F.round("x", 2) * 100).cast("long").alias("c"))
    counts = cut(o.groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    first = prefix_sums(counts, "c", "n", "before").select("c", F.least(F.floor(F.col("before") * k / total), F.lit(k - 1)).alias("f"))
    labels = first.select("f").distinct().select("f", (F.dense_rank().over(Window.orderBy("f")) - 1).cast("long").alias("fold"))
    return o.join(first.join(F.broadcast(labels), "f"), "c").select("obs_id", "fold")


@query("WIN-05", "obs", "select * from fd", _FOLD)
def contiguous_folds(s, d):
    return folds(s, d)


@query("LIN-10 SET-06", "obs", "select k fold, count_if(fold = k) test, count_if(fold <> k) train from fd, (select distinct fold k from fd) group by k", _FOLD)
def fold_roles(s, d):
    f = folds(s, d)
    names = f.select(F.col("fold").alias("k")).distinct()
    sizes = f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    return names.crossJoin(F.broadcast(sizes)).groupBy(F.col("k").alias("fold")).agg(F.sum(F.when(F.col("fold") == F.col("k"), F.col("n")).otherwise(0)).alias("test"), F.sum(F.when(F.col("fold") != F.col("k"), F.col("n")).otherwise(0)).alias("train"))


@query("WIN-06", "links", "select target, round(coalesce(quantile_cont(case when k > 1 then rho end, .5), 0), 6) + 0.0 median_other from (select target, rho, row_number() over (partition by target order by rho desc, region) k from links where rho is not null) group by target")
def median_of_others(s, d):
    placed = A.links(s, d).where("rho is not null").withColumn("k", pick([F.desc("rho"), F.col("region")], ["target"]))
    return placed.groupBy("target").agg(r(F.coalesce(F.percentile(F.when(F.col("k") > 1, F.col("rho")), F.lit(0.5)), F.lit(0.0))).alias("median_other"))


@query("WIN-09 LIN-16", "pixel", 'select round(avg(abs(dx)) + avg(abs(dy)), 6) + 0.0 tv from (select lead(v) over (partition by "row" order by col) - v dx, lead(v) over (partition by col order by "row") - v dy from lat)', {"lat": 'select r.r "row", c.c col, coalesce(p.value, 0) v from (select unnest(range(76))::int r) r cross join (select unnest(range(101))::int c) c left join pixel p on p."row" = r.r and p.col = c.c'})
def total_variation(s, d):
    v = A.lattice(s).join(A.pixels(s, d), ["row", "col"], "left").withColumn("v", F.coalesce("value", F.lit(0.0)))
    dx = F.lead("v").over(Window.partitionBy("row").orderBy("col")) - F.col("v")
    dy = F.lead("v").over(Window.partitionBy("col").orderBy("row")) - F.col("v")
    return v.select(dx.alias("dx"), dy.alias("dy")).agg(r(F.avg(F.abs("dx")) + F.avg(F.abs("dy"))).alias("tv"))


@query("WIN-10", "cells", "select round(avg((mx / t >= .05)::int), 6) + 0.0 coverage from (select obs_id, max(greatest(value, 0)) mx, sum(greatest(value, 0)) + 1e-8 t from cells group by obs_id)")
def dominance_coverage(s, d):
    v = F.greatest("value", F.lit(0.0))
    return A.cells(s, d).groupBy("obs_id").agg(F.max(v).alias("mx"), (F.sum(v) + 1e-8).alias("t")).agg(r(F.avg((F.col("mx") / F.col("t") >= 0.05).cast("int"))).alias("coverage"))


@query("TOP-02", "", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def largest_orders(s, d):
    return T(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("TOP-04", "", "select distinct p_partkey from (select p_partkey from (select p_partkey from part order by p_partkey limit 10) union all select p_partkey from part where p_partkey in (3, 77, 99))")
def first_and_forced(s, d):
    p = T(s, d, "part").select("p_partkey")
    return p.orderBy("p_partkey").limit(10).unionByName(p.where("p_partkey in (3, 77, 99)")).distinct()


@query("TOP-06", "links", "select row_number() over (order by rho desc nulls last, importance asc, target, region) k, target, region from links")
def multi_key_order(s, d):
    order = [F.desc_nulls_last("rho"), F.col("importance"), F.col("target"), F.col("region")]
    return numbered(A.links(s, d), order, "k").select("k", "target", "region")


@query("TOP-07", "links", "select target, arg_max(region, (rho, -region)) best from links where rho is not null group by target")
def argmax(s, d):
    return A.links(s, d).where("rho is not null").groupBy("target").agg(F.max_by("region", F.struct(F.col("rho"), -F.col("region"))).alias("best"))


@query("SET-01 SET-03", "links", "select target, region, src from (select *, row_number() over (partition by target, region order by src) k from (select target, region, 1 src from links where rho > .1 union all select target, region, 2 from links where importance > 900000)) where k = 1")
def union_with_priority(s, d):
    base = A.links(s, d)
    both = base.where("rho > 0.1").select("target", "region", F.lit(1).alias("src")).unionByName(base.where("importance > 900000").select("target", "region", F.lit(2).alias("src")))
    return both.withColumn("k", pick([F.col("src")], ["target", "region"])).where("k = 1").drop("k")


@query("SET-04 SET-05", "", "select 'both' kind, count(*) n from (select c_nationkey from customer intersect select s_nationkey from supplier) union all select 'only', count(*) from (select l_partkey from lineitem except select p_partkey from part where p_partkey % 2 = 0)")
def intersect_and_except(s, d):
    both = T(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(T(s, d, "supplier").select(F.col("s_nationkey").alias("k")))
    only = T(s, d, "lineitem").select(F.col("l_partkey").alias("k")).subtract(T(s, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k")))
    count = lambda f, n: f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("kind"), "n")
    return count(both, "both").unionByName(count(only, "only"))


@query("SET-06 SPA-25", "cells", "select u.var_id, round(sum((u.value > .1)::int * (v.value > .05)::int)::double / (sum(greatest((u.value > .1)::int, (v.value > .05)::int)) + 1e-8), 6) + 0.0 jaccard, round(avg((u.value > .1)::int), 6) + 0.0 area_a, round(sum((v.value > .05)::int)::double / greatest(sum((u.value > .1)::int), 1), 6) + 0.0 area_ratio from cells u join cells v on u.obs_id = v.obs_id and v.var_id = u.var_id + 1 group by u.var_id")
def mask_overlap(s, d):
    """The mask of each variable against that of the next one, side by side in the observation's row."""
    pairs = T(s, d, "embeddings").select(F.expr("explode(transform(sequence(0, size(embedding) - 2), i -> struct(i as var_id, int(double(embedding[i]) > 0.1D) as a, int(double(embedding[i + 1]) > 0.05D) as b)))").alias("p")).select("p.*")
    return pairs.groupBy("var_id").agg(r(F.sum(F.col("a") * F.col("b")) / (F.sum(F.greatest("a", "b")) + 1e-8)).alias("jaccard"), r(F.avg("a")).alias("area_a"), r(F.sum("b") / F.greatest(F.sum("a"), F.lit(1))).alias("area_ratio"))


@query("FIG-07", "cells", "select a.var_id, round(avg(log2((greatest(a.value, 0) + 1e-3) / (greatest(b.value, 0) + 1e-3))), 6) + 0.0 mean_logfc from cells a join cells b on a.obs_id = b.obs_id and b.var_id = 3 and b.value > 0.05 where a.var_id between 11 and 30 group by a.var_id")
def active_logfc(s, d):
    c = A.cells(s, d)
    base = c.where("var_id = 3 and value > 0.05").select("obs_id", F.col("value").alias("b"))
    v = F.log2((F.greatest("value", F.lit(0.0)) + 1e-3) / (F.greatest("b", F.lit(0.0)) + 1e-3))
    return c.where("var_id between 11 and 30").join(base, "obs_id").groupBy("var_id").agg(r(F.avg(v)).alias("mean_logfc"))


# ---- along time ----
_EVENTS = "select event_id, user_id, event_type, value, (epoch_us(ts) // 1000000)::bigint s from events"


def _events(s, d):
    return T(s, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_timestamp("ts").alias("s"))


@query("REL-20", "", "select p.event_id, max_by(c.event_id, (c.s, c.event_id)) click_id, p.s - max(c.s) gap from e p left join (select * from e where event_type = 'click') c on c.user_id = p.user_id and c.s between p.s - 21600 and p.s where p.event_type = 'purchase' group by p.event_id, p.s", {"e": _EVENTS})
def as_of_events(s, d):
    """The last click of the same user within six hours up to each purchase."""
    e = _events(s, d)
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("s").alias("at"))
    found = I.as_of_join(e.where("event_type = 'purchase'"), clicks, ["user_id"], "s", "at", "click_id", 21600)
    return found.select("event_id", "found.click_id", (F.col("s") - F.col("found.at")).alias("gap"))


@query("REL-20", "peak", "select peak, event_id gene, least(p.\"end\", g.e) - greatest(p.start, g.s) shared from peak p join (select *, s + 60 + floor(value * 600)::bigint e from e where event_type = 'signup') g on g.user_id = p.chrom and p.start < g.e and g.s < p.\"end\"", {"e": _EVENTS})
def overlapping_intervals(s, d):
    """All peaks and intervals of very different lengths that share a point, and how much they share."""
    spans = _events(s, d).where("event_type = 'signup'").select(F.col("event_id").alias("gene"), F.col("user_id").alias("chrom"), F.col("s").alias("start"), (F.col("s") + 60 + F.floor(F.col("value") * 600)).alias("end"))
    met = I.overlap_join(A.peaks(s, d).select("peak", "chrom", "start", "end"), spans, ["chrom"], "start", "end", 512)
    return met.select("a.peak", "b.gene", (F.least("a.end", "b.end") - F.greatest("a.start", "b.start")).alias("shared"))


@query("WIN-11", "", "select event_id, count(*) over w n, round(sum(value) over w, 4) + 0.0 total, max(value) over w most from e window w as (partition by user_id order by s range between 21600 preceding and current row)", {"e": _EVENTS})
def trailing_frames(s, d):
    """What each user did in the six hours up to each event, in blocks of time."""
    found = I.range_frame(_events(s, d), ["user_id"], "s", 21600, {"n": F.count(F.lit(1)), "total": F.sum("value"), "most": F.max("value")})
    return found.select("event_id", "n", r("total", 4).alias("total"), "most")


@query("AGG-24", "", "select event_type, kind, count(*) n, round(sum(value), 2) + 0.0 total, grouping(event_type, kind)::bigint level from (select event_type, case when value is null then 'none' when value < 5 then 'low' else 'high' end kind, value from events) group by cube (event_type, kind)")
def event_cube(s, d):
    """Counts and totals by type and kind, by each alone, and of all, from one grouping."""
    rows = T(s, d, "events").select("event_type", F.expr("case when value is null then 'none' when value < 5 then 'low' else 'high' end").alias("kind"), "value")
    return rows.cube("event_type", "kind").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("value"), 2) + F.lit(0.0)).alias("total"), F.grouping_id().cast("long").alias("level"))


@query("AGG-24")
def merged_sketches(s, d):
    """Distinct users, quantiles of values and most frequent users, by type of event, merged from sketches kept by day."""
    path = f"{scratch(s)}/sketches"
    K.sketch(T(s, d, "events").withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id", "value").write.parquet(path)
    return K.merge(s.read.parquet(path), ["event_type"]).select("event_type", "n", "distinct", *[F.get("quantiles", i).alias(f"q{q}") for i, q in enumerate((50, 90, 99))], "frequent")
