"""Queries: linear models, gates, losses, attribution, simulations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.numeric import entropy, pick, r
from terrane.operators import evidence as E
from terrane.operators import linear as L
from terrane.operators import simulate as M
from terrane.plans.registry import query
from terrane.plans.relational_queries import _FOLD, folds
from terrane.sources import adapters as A

#: Rows for models: each gene's signal, its first four drivers side by side (a model's features), and a fold.
WIDE = _FOLD | {
    "wd": "select p.gene, p.obs_id, any_value(p.domain) domain, any_value(fd.fold) fold, any_value(y) y, max(case when enh = 0 then x end) x0, max(case when enh = 1 then x end) x1, max(case when enh = 2 then x end) x2, max(case when enh = 3 then x end) x3 from paired p join fd using (obs_id) where enh < 4 group by p.gene, p.obs_id",
}
FEATURES = ["x0", "x1", "x2", "x3"]


def _wide(s, d):
    p = A.paired(s, d).where("enh < 4")
    wide = p.groupBy("gene", "obs_id").agg(F.first("domain").alias("domain"), F.first("y").alias("y"), *[F.max(F.when(F.col("enh") == i, F.col("x"))).alias(f"x{i}") for i in range(4)])
    return wide.join(folds(s, d), "obs_id")


def _folded(s, d):
    """gene, obs_id, domain, fold, y, x: each gene's signal and all its drivers, as an array."""
    return A.signals(s, d).join(folds(s, d), "obs_id")


@query("LIN-01", "paired obs", "select gene, obs_id, round(y - (my - sl * mx + sl * x0), 6) + 0.0 residual from wd join (select gene, case when stddev_pop(x0) < 1e-8 then 0 else covar_pop(x0, y) / var_pop(x0) end sl, avg(x0) mx, avg(y) my from wd group by gene) using (gene)", WIDE)
def fit_residuals(s, d):
    w = _wide(s, d)
    f = w.groupBy("gene").agg(F.when(F.stddev_pop("x0") < 1e-8, 0.0).otherwise(F.covar_pop("x0", "y") / F.var_pop("x0")).alias("sl"), F.avg("x0").alias("mx"), F.avg("y").alias("my"))
    return w.join(f, "gene").select("gene", "obs_id", r(F.col("y") - (F.col("my") - F.col("sl") * F.col("mx") + F.col("sl") * F.col("x0"))).alias("residual"))


@query("LIN-02 LIN-05", "paired obs", "select gene, obs_id, round(m, 6) + 0.0 prediction, round(y, 6) + 0.0 observed from wd join (select gene, avg(y) m from wd where fold <> 4 group by gene) using (gene) where fold = 4", WIDE)
def mean_baseline(s, d):
    w = _wide(s, d)
    m = w.where("fold <> 4").groupBy("gene").agg(F.avg("y").alias("m"))
    return w.where("fold = 4").join(m, "gene").select("gene", "obs_id", r("m").alias("prediction"), r("y").alias("observed"))


_SINGLE = _FOLD | {
    "lo": "select gene, obs_id, fold, y, enh j, x from paired join fd using (obs_id)",
    "fs": "select gene, j, greatest(case when var_pop(x) > 0 then covar_pop(x, y) / var_pop(x) else 0 end, 0) sl, avg(x) mx, avg(y) my, var_pop(y) vy, covar_pop(x, y) c, var_pop(x) vx from lo where fold <> 4 group by gene, j",
    "bs": "select gene, j, sl, mx, my from fs qualify row_number() over (partition by gene order by round(vy - 2 * sl * c + sl * sl * vx, 9), j) = 1",
}


@query("LIN-03", "paired obs", "select lo.gene, obs_id, lo.j selected, round(my + sl * (x - mx), 6) + 0.0 prediction from lo join bs on lo.gene = bs.gene and lo.j = bs.j where fold = 4", _SINGLE)
def best_single_driver(s, d):
    """The best of all drivers by training error, and what it predicts for the held-out fold."""
    w = _folded(s, d)
    slope = F.greatest(F.when(F.var_pop("x") > 0, F.covar_pop("x", "y") / F.var_pop("x")).otherwise(0.0), F.lit(0.0))
    long = w.where("fold <> 4").select("gene", "y", F.posexplode("x").alias("j", "x"))
    fits = long.groupBy("gene", "j").agg(slope.alias("sl"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"))
    best = fits.withColumn("place", pick([F.round(F.expr("vy - 2 * sl * c + sl * sl * vx"), 9), F.col("j")], ["gene"])).where("place = 1")
    chosen = w.where("fold = 4").join(best.select("gene", "j", "sl", "mx", "my"), "gene").withColumn("v", F.get("x", "j"))
    return chosen.select("gene", "obs_id", F.col("j").alias("selected"), r(F.expr("my + sl * (v - mx)")).alias("prediction"))


@query("LIN-04")
def elastic_net(s, d):
    """Nonnegative elastic net weights of all drivers on the training folds, by gene, with the largest violation of their optimality conditions."""

    def model(frame):
        g = frame["gram"].iloc[0]
        w, b = L.elastic_net(g)
        gap, gene = L.optimality_gap(g, w), int(frame["gene"].iloc[0])
        return [(gene, f"x{i}", float(v), b, gap) for i, v in enumerate(w)]

    return L.solve_groups(L.gram_rows(_folded(s, d).where("fold <> 4"), ["gene"]), "gene", model, "gene int, feature string, weight double, intercept double, gap double")


@query("LIN-06", "paired obs", "select gene, domain, count(*) n, round(avg((y - x0) * (y - x0)), 6) + 0.0 mse, round(1 - sum((y - x0) * (y - x0)) / (var_pop(y) * count(*) + 1e-12), 4) + 0.0 r2, round(case when stddev_pop(y) * stddev_pop(x0) > 0 then covar_pop(y, x0) / (stddev_pop(y) * stddev_pop(x0)) else 0 end, 6) + 0.0 pearson from wd group by gene, domain", WIDE)
def prediction_metrics(s, d):
    got = _wide(s, d).groupBy("gene", "domain").agg(*L.prediction_metrics(F.col("y"), F.col("x0")))
    return got.select("gene", "domain", "n", r("mse").alias("mse"), r("r2", 4).alias("r2"), r("pearson").alias("pearson"))


@query("LIN-07 LIN-09")
def nested_feature_gate(s, d):
    """All drivers against all drivers by domain (the native spatial model), in nested refits by fold."""

    def model(frame):
        domains, k = sorted(frame["domain"].unique()), len(frame["gram"].iloc[0]) - 2
        empty = np.zeros((k + 2, k + 2))
        of = {(row.fold, row.domain): row.gram for row in frame.itertuples()}
        per_fold = {int(f): L.by_domain([of.get((f, m), empty) for m in domains]) for f in sorted(frame["fold"].unique())}
        enabled, rows = L.nested_gate(per_fold, list(range(k)), list(range(k, k * (len(domains) + 1))), test_fold=4)
        gene = int(frame["gene"].iloc[0])
        return [(gene, x["validation_fold"], x["global_mse"], x["spatial_mse"], x["relative_gain"], x["improved"], enabled) for x in rows]

    grams = L.gram_rows(_folded(s, d), ["gene", "fold", "domain"])
    return L.solve_groups(grams, "gene", model, "gene int, validation_fold int, global_mse double, spatial_mse double, relative_gain double, improved boolean, enabled boolean")


_GATE = WIDE | {
    "bf": "select gene, fold, y t, x2 b, x1 f from wd where fold <> 4",
    "sm": "select gene, fold, sum((t - b) * (f - b)) num, sum((f - b) * (f - b)) den, sum((t - b) * (t - b)) bb, count(*) n from bf group by gene, fold",
    "ca": "select a.gene, a.fold, least(greatest(round((t.num - a.num) / greatest(t.den - a.den, 1e-12), 9), 0), 1) c, a.num, a.den, a.bb, a.n from sm a join (select gene, sum(num) num, sum(den) den from sm group by gene) t using (gene)",
    "ga": "select gene, fold, c, bb / n base_mse, (bb - 2 * c * num + c * c * den) / n cal_mse from ca",
    "gg": "select *, round((base_mse - cal_mse) / greatest(base_mse, 1e-12), 6) + 0.0 gain from ga",
}


@query("LIN-08 LIN-09", "paired obs", "select gene, round(quantile_disc(c, .5), 6) + 0.0 candidate, count_if(gain > 0) improved, round(avg(gain), 6) + 0.0 mean_gain, min(gain) worst_gain, count_if(gain > 0) >= 3 and avg(gain) >= .002 and min(gain) >= -.01 enabled from gg group by gene", _GATE)
def spatial_gate(s, d):
    """Closed-form strength for each held fold from the other folds' sums; the lower median of candidates."""
    b = _wide(s, d).where("fold <> 4").select("gene", "fold", F.col("y").alias("t"), F.col("x2").alias("b"), F.col("x1").alias("f"))
    delta, miss = F.col("f") - F.col("b"), F.col("t") - F.col("b")
    sums = b.groupBy("gene", "fold").agg(F.sum(miss * delta).alias("num"), F.sum(delta * delta).alias("den"), F.sum(miss * miss).alias("bb"), F.count(F.lit(1)).alias("n"))
    rest = lambda c: F.sum(c).over(Window.partitionBy("gene")) - F.col(c)
    strength = F.least(F.greatest(F.round(rest("num") / F.greatest(rest("den"), F.lit(1e-12)), 9), F.lit(0.0)), F.lit(1.0))
    held = sums.withColumn("c", strength).withColumn("base", F.col("bb") / F.col("n")).withColumn("cal", F.expr("(bb - 2 * c * num + c * c * den) / n"))
    gain = held.withColumn("gain", r((F.col("base") - F.col("cal")) / F.greatest("base", F.lit(1e-12))))
    improved = F.count_if(F.col("gain") > 0)
    return gain.groupBy("gene").agg(r(F.expr("percentile_disc(0.5) within group (order by c)")).alias("candidate"), improved.alias("improved"), r(F.avg("gain")).alias("mean_gain"), F.min("gain").alias("worst_gain"), ((improved >= 3) & (F.avg("gain") >= 0.002) & (F.min("gain") >= -0.01)).alias("enabled"))


@query("LIN-11", "paired", "select gene, round(avg(2 * lo / (sa + sb + 1e-8)), 6) + 0.0 overlap from (select a.gene, a.enh i, b.enh j, sum(least(a.x, b.x)) lo, sum(a.x) sa, sum(b.x) sb from paired a join paired b on a.obs_id = b.obs_id and a.gene = b.gene and a.enh < b.enh group by all) group by gene")
def attribution_overlap(s, d):
    # An observation's few drivers are paired within its row: no join.
    row = A.paired(s, d).groupBy("gene", "obs_id").agg(F.sort_array(F.collect_list(F.struct("enh", "x"))).alias("m"))
    both = row.select("gene", "m", F.explode("m").alias("a")).select("gene", "a", F.explode(F.filter("m", lambda b: b["enh"] > F.col("a.enh"))).alias("b"))
    dice = both.groupBy("gene", F.col("a.enh"), F.col("b.enh").alias("j")).agg((2 * F.sum(F.least("a.x", "b.x")) / (F.sum("a.x") + F.sum("b.x") + 1e-8)).alias("v"))
    return dice.groupBy("gene").agg(r(F.avg("v")).alias("overlap"))


@query("LIN-12", "paired", "select gene, enh, domain, round(avg(x), 6) + 0.0 mass from paired group by all")
def attribution_mass(s, d):
    return A.paired(s, d).groupBy("gene", "enh", "domain").agg(r(F.avg("x")).alias("mass"))


@query("LIN-14", "paired obs", "select gene, round(avg(case when abs(y - x0) <= 1 then .5 * (y - x0) * (y - x0) else abs(y - x0) - .5 end), 6) + 0.0 huber from wd where domain <> 3 group by gene", WIDE)
def masked_huber(s, d):
    e = F.abs(F.col("y") - F.col("x0"))
    return _wide(s, d).where("domain <> 3").groupBy("gene").agg(r(F.avg(F.when(e <= 1, 0.5 * e * e).otherwise(e - 0.5))).alias("huber"))


@query("LIN-15", "paired obs", "select gene, round(sum(greatest(sp - ba, 0)) / 5, 6) + 0.0 safety from (select gene, fold, avg((x1 - y) * (x1 - y)) sp, avg((x2 - y) * (x2 - y)) ba from wd group by gene, fold) group by gene", WIDE)
def block_safety(s, d):
    sq = lambda c: F.avg((F.col(c) - F.col("y")) ** 2)
    blocks = _wide(s, d).groupBy("gene", "fold").agg(sq("x1").alias("sp"), sq("x2").alias("ba"))
    return blocks.groupBy("gene").agg(r(F.sum(F.greatest(F.col("sp") - F.col("ba"), F.lit(0.0))) / 5).alias("safety"))


@query("LIN-17", "paired", "select gene, round(avg(e), 6) + 0.0 entropy from (select gene, obs_id, -sum(p * ln(p)) e from (select gene, obs_id, greatest(x / (sum(x) over (partition by gene, obs_id) + 1e-8), 1e-8) p from paired) group by all) group by gene")
def attribution_entropy(s, d):
    share = F.greatest(F.col("x") / (F.sum("x").over(Window.partitionBy("gene", "obs_id")) + 1e-8), F.lit(1e-8))
    each = A.paired(s, d).select("gene", "obs_id", share.alias("p")).groupBy("gene", "obs_id").agg((-F.sum(F.col("p") * F.log("p"))).alias("e"))
    return each.groupBy("gene").agg(r(F.avg("e")).alias("entropy"))


@query("LIN-18", "paired", "select gene, enh, round((any_value(neg)::double / greatest(any_value(pos), 1) * sum(case when t = 1 then l else 0 end) + sum(case when t = 0 then l else 0 end)) / count(*), 6) + 0.0 bce from (select gene, enh, t, greatest(z, 0) - z * t + ln(1 + exp(-abs(z))) l, count_if(t = 0) over (partition by gene, enh) neg, count_if(t = 1) over (partition by gene, enh) pos from (select gene, enh, x * 4 - 1 z, (y > .1)::int t from paired)) group by gene, enh")
def balanced_bce(s, d):
    p = A.paired(s, d).select("gene", "enh", (F.col("x") * 4 - 1).alias("z"), (F.col("y") > 0.1).cast("int").alias("t"))
    loss = F.greatest("z", F.lit(0.0)) - F.col("z") * F.col("t") + F.log1p(F.exp(-F.abs("z")))
    positive, of = F.col("t") == 1, lambda good: F.sum(F.when(good, loss).otherwise(0.0))
    weight = F.count_if(~positive) / F.greatest(F.count_if(positive), F.lit(1))
    return p.groupBy("gene", "enh").agg(r((weight * of(positive) + of(~positive)) / F.count(F.lit(1))).alias("bce"))


_FWD = {
    "pt": "select obs_id, gene, enh, domain, y, x activity, round(sin(enh * 3 + domain) * 2, 6) logit, .1 + enh * .05 fixed, .2 + (enh % 3) * .1 learned, domain * .3 - 1 background, .05 intercept from paired",
    "mp": "select *, fixed + {s} * (learned * (1 + tanh(logit)) - fixed) attribution from pt",
    "tot": "select obs_id, gene, any_value(y) y, any_value(domain) domain, sum(greatest(activity, 0) * attribution) + any_value(intercept) + {s} * ln(1 + exp(any_value(background))) prediction, sum(greatest(activity, 0) * fixed) + any_value(intercept) global_prediction from mp group by obs_id, gene",
}


def _parts(s, d):
    return A.paired(s, d).select(
        "obs_id", "gene", "enh", "domain", "y", F.col("x").alias("activity"), F.round(F.sin(F.col("enh") * 3 + F.col("domain")) * 2, 6).alias("logit"), (0.1 + F.col("enh") * 0.05).alias("fixed"),
        (0.2 + (F.col("enh") % 3) * 0.1).alias("learned"), (F.col("domain") * 0.3 - 1).alias("background"), F.lit(0.05).alias("intercept"),
    )


def _fwd(strength):
    return {k: v.format(s=f"{strength}::double") for k, v in _FWD.items()}


@query("ATT-01 ATT-07 LIN-13", "paired", "select obs_id, gene, round(prediction, 6) + 0.0 prediction, round(global_prediction, 6) + 0.0 global_prediction from tot", _fwd(0.6))
def attribution_forward(s, d):
    _, total = L.forward(_parts(s, d), ["obs_id", "gene"], 0.6)
    return total.select("obs_id", "gene", r("prediction").alias("prediction"), r("global_prediction").alias("global_prediction"))


@query("ATT-01", "paired", "select gene, max(abs(round(prediction - global_prediction, 9))) + 0.0 gap from tot group by gene", _fwd(0.0))
def zero_strength_is_global(s, d):
    _, total = L.forward(_parts(s, d), ["obs_id", "gene"], 0.0)
    return total.groupBy("gene").agg((F.max(F.abs(F.round(F.col("prediction") - F.col("global_prediction"), 9))) + 0.0).alias("gap"))


@query("ATT-06", "paired", "select gene, round(avg(case when abs(prediction - y) <= 1 then .5 * pow(prediction - y, 2) else abs(prediction - y) - .5 end) + 0.01 * (select avg(abs(greatest(activity, 0) * attribution)) from mp where mp.gene = tot.gene), 6) + 0.0 loss from tot group by gene", _fwd(0.6))
def total_loss(s, d):
    maps, total = L.forward(_parts(s, d), ["obs_id", "gene"], 0.6)
    y = _parts(s, d).select("obs_id", "gene", "y").distinct()
    e = F.abs(F.col("prediction") - F.col("y"))
    fit = total.join(y, ["obs_id", "gene"]).groupBy("gene").agg(F.avg(F.when(e <= 1, 0.5 * e * e).otherwise(e - 0.5)).alias("h"))
    size = maps.groupBy("gene").agg(F.avg(F.abs("contribution")).alias("c"))
    return fit.join(size, "gene").select("gene", r(F.col("h") + 0.01 * F.col("c")).alias("loss"))


@query("ATT-08", "paired", "select mp.gene, mp.enh, round(avg(pow(tot.prediction - greatest(activity, 0) * attribution - tot.y, 2)) - avg(pow(tot.prediction - tot.y, 2)), 6) + 0.0 delta_loss from mp join tot using (obs_id, gene) where mp.domain in (0, 5) group by mp.gene, mp.enh", _fwd(0.6))
def ablation(s, d):
    """Loss without each driver less the loss with it: the algebra adds up, so leaving one out is a subtraction."""
    maps, total = L.forward(_parts(s, d), ["obs_id", "gene"], 0.6)
    j = maps.where("domain in (0, 5)").join(total, ["obs_id", "gene"])
    without, whole = F.col("prediction") - F.col("contribution") - F.col("y"), F.col("prediction") - F.col("y")
    return j.groupBy("gene", "enh").agg(r(F.avg(without * without) - F.avg(whole * whole)).alias("delta_loss"))


@query("ATT-09", "paired", "select obs_id, gene, enh, round(activity / (1 + exp(-logit)), 6) + 0.0 gated from pt", {"pt": _FWD["pt"]})
def gated_features(s, d):
    return _parts(s, d).select("obs_id", "gene", "enh", r(F.col("activity") / (1 + F.exp(-F.col("logit")))).alias("gated"))


@query("ATT-02 ATT-03 ATT-04")
def set_encoder(s, d):
    """Logits and scales of drivers' maps from the convolution and set encoders, then the forward algebra."""
    from terrane.operators.setmodel import encode_genes

    p = A.paired(s, d).where("obs_id < 500 and gene < 2 and enh < 4").select("gene", "enh", (F.col("obs_id") / 25).cast("int").alias("row"), (F.col("obs_id") % 25).cast("int").alias("col"), F.col("x").alias("activity"))
    parts = p.join(encode_genes(p), ["gene", "enh", "row", "col"]).select("*", F.lit(0.2).alias("fixed"), F.lit(-1.0).alias("background"), F.lit(0.0).alias("intercept"))
    return L.forward(parts, ["gene", "row", "col"], 1.0)[1]


# ---- simulations: known truth laid over what the given lines show at each pixel, which their noise follows ----
def _seen(s, d):
    return A.table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 48).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col")).agg(F.avg("l_quantity").alias("value"))


_SIM = {
    "gd": "select r.r \"row\", c.c col, c.c / 63.0::double x, r.r / 47.0::double y from (select unnest(range(48))::int r) r cross join (select unnest(range(64))::int c) c",
    "gt": "select *, (pow((x - .5) / .48, 2) + pow((y - .5) / .43, 2) <= 1) tissue from gd",
    "ob": "select (l_suppkey % 48)::int \"row\", (l_partkey % 64)::int col, count(*) n from lineitem group by all",
    "sm": "select \"row\", col, tissue, exp(-(pow(x - .3, 2) + pow(y - .5, 2)) / (2 * .16 * .16)) * tissue::int l, exp(-(pow(x - .7, 2) + pow(y - .5, 2)) / (2 * .16 * .16)) * tissue::int rr, (x <= .5)::int west from gt",
}


@query("SIM-01 SIM-02 SIM-03", "", 'select "row", col, enh, round(case when enh = 0 then l else rr end, 6) + 0.0 activity, ((case when enh = 0 then west else 1 - west end) * tissue::int)::double attribution, round(l * west + rr * (1 - west), 6) + 0.0 gene, coalesce(n, 0) lines from sm left join ob using ("row", col), (select unnest([0, 1]) enh)', _SIM)
def simulated_complementary(s, d):
    m = M.decomposition(s, "complementary", drivers=2)
    lines = A.table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 48).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col")).agg(F.count(F.lit(1)).alias("lines"))
    return m.join(lines, ["row", "col"], "left").select("row", "col", "enh", r("activity").alias("activity"), r("attribution").alias("attribution"), r("gene").alias("gene"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query("SIM-01")
def simulated_scenarios(s, d):
    """All six scenarios with noise: totals of activity, attribution and signal."""
    out, seen = None, _seen(s, d)
    for name in M.SCENARIOS:
        part = M.decomposition(s, name, noise=0.04, seen=seen).groupBy("enh").agg(F.sum("activity").alias("activity"), F.sum("attribution").alias("attribution"), F.sum("gene").alias("gene")).withColumn("scenario", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("SIM-04 COR-07 AGG-20")
def simulated_recovery(s, d):
    """The mixed simulation through evidence, permutation and classes: drivers by true and predicted class."""
    m = M.mixed_complexity(s, seen=_seen(s, d)).where("tissue")
    domain = (F.least((F.col("row") * 2 / 48).cast("int"), F.lit(1)) * 3 + F.least((F.col("col") * 3 / 64).cast("int"), F.lit(2))).alias("domain")
    pix = m.select(F.lit(0).alias("gene"), "enh", "row", "col", domain, F.col("activity").alias("x"), F.col("gene").alias("y"))
    observed = E.evidence(pix, policy="zero_std")
    shifts = [((7 * p + 11) % 48, (13 * p + 17) % 64) for p in range(39)]
    confirmed = E.permutation_p(observed, E.toroidal_null(pix, shifts, 48, 64), E.KEYS, 39)
    classed = E.classify(confirmed, E.Thresholds(core=0.65, local=0.45, evidence=0.03), with_q=True)
    truth = m.select("enh", "truth").distinct()
    return classed.join(truth, "enh").groupBy("truth", "predicted_class").agg(F.count(F.lit(1)).alias("n"))


@query("SIM-05", "pixel", 'select "row", col, (col // 12 + 2 * ("row" // 12)) % 4 internal_fold, least(col * 5 // 101, 4) vertical_fold from pixel')
def checkerboard_folds(s, d):
    """Folds of all observed pixels: a checkerboard of an eighth of the columns by a sixth of the rows, and vertical slabs."""
    across, down = A.GRID_COLS // 8, A.GRID_ROWS // 6
    inner = (F.floor(F.col("col") / across) + 2 * F.floor(F.col("row") / down)) % 4
    return A.pixels(s, d).select("row", "col", inner.cast("int").alias("internal_fold"), F.least(F.floor(F.col("col") * 5 / A.GRID_COLS), F.lit(4)).cast("int").alias("vertical_fold"))


@query("FIG-05", "paired", "select gene, enh, round(case when stddev_pop(x) >= 1e-8 and stddev_pop(y) >= 1e-8 and count(*) >= 3 then covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) end, 6) + 0.0 raw_rho, round(case when stddev_pop(case when y > .08 then x end) >= 1e-8 and stddev_pop(case when y > .08 then y end) >= 1e-8 and count_if(y > .08) >= 3 then covar_pop(case when y > .08 then x end, case when y > .08 then y end) / (stddev_pop(case when y > .08 then x end) * stddev_pop(case when y > .08 then y end)) end, 6) + 0.0 latent_rho from paired group by gene, enh")
def raw_and_latent_links(s, d):
    from terrane.functions.numeric import correlation, moments

    p = A.paired(s, d).withColumn("lx", F.when(F.col("y") > 0.08, F.col("x"))).withColumn("ly", F.when(F.col("y") > 0.08, F.col("y")))
    got = p.groupBy("gene", "enh").agg(*moments("x", "y"), *moments("lx", "ly", "l"))
    return got.select("gene", "enh", r(correlation("null")).alias("raw_rho"), r(correlation("null", "l")).alias("latent_rho"))


# ---- run management ----
@query("SNK-05 SNK-10 SNK-06")
def resumable_chunks(s, d):
    """Targets' summaries in chunks; the second run finds all chunks done and adds nothing."""
    from terrane.sources.tables import run_chunks, scratch

    rows = A.targets(s, d).withColumn("chunk", F.col("gene") % 3)
    path = f"{scratch(s)}/chunks"
    work = lambda f: f.groupBy("chunk", "gene").agg(F.avg("y").alias("mean"))
    run_chunks(rows.where("chunk < 2"), "chunk", work, path)
    return run_chunks(rows, "chunk", work, path)


@query("SNK-03 SNK-04 SRC-01")
def star_and_manifest(s, d):
    """The star schema and a manifest written and read back: rows by part, and the manifest's count."""
    from terrane.sources.tables import read_manifest, scratch, write_manifest, write_star

    base = scratch(s)
    parts = {"obs": A.observations(s, d), "cells": A.cells(s, d)}
    write_star(parts, base, {"cells": "var_id"})
    write_manifest(s, f"{base}/manifest", {"parts": sorted(parts), "source": d})
    n = len(read_manifest(s, f"{base}/manifest")["parts"])
    out = None
    for name in parts:
        row = s.read.parquet(f"{base}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n", F.lit(n).alias("parts"))
        out = row if out is None else out.unionByName(row)
    return out


@query("AGG-24", "", "select date_trunc('hour', ts) as start, event_type, count(*) n, round(sum(value), 4) + 0.0 as value from events group by all")
def streamed_event_windows(s, d):
    """Extension: all events by hour and type through Structured Streaming, with a watermark."""
    from terrane.streaming.windows import event_windows

    return event_windows(s, d).withColumn("value", r("value", 4))
