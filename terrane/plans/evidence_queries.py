"""Queries: evidence screen, permutation confirmation, ranking."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.numeric import adjusted, correlation, entropy, moments, pick, r, with_q_values
from terrane.operators import evidence as E
from terrane.operators.lineage import cut
from terrane.operators.order import centred_ranks, prefix_sums, sliced
from terrane.operators.periodic import random_shifts, shifted_null, shifted_sources, unit_box
from terrane.plans.registry import query
from terrane.sources import adapters as A

_COR = "case when sqrt(greatest(sxx - sx * sx / n, 0) * greatest(syy - sy * sy / n, 0)) > {eps} {more} then (sxy - sx * sy / n) / sqrt(greatest(sxx - sx * sx / n, 0) * greatest(syy - sy * sy / n, 0)) else 0 end"
_R = "round({}, 6) + 0.0"
_CORR = _R.format(_COR.format(eps="1e-9", more=""))
_SUMS = "count(*) n, sum(x) sx, sum(y) sy, sum(x * x) sxx, sum(y * y) syy, sum(x * y) sxy"
EV = {
    "sums": f"select gene, enh, domain, {_SUMS} from paired group by all",
    "loc": f"select gene, enh, domain, n, {_CORR} local from sums",
    "glo": f"select gene, enh, {_CORR} global_concordance from (select gene, enh, sum(n) n, sum(sx) sx, sum(sy) sy, sum(sxx) sxx, sum(syy) syy, sum(sxy) sxy from sums group by all)",
    "rk": "select *, row_number() over (partition by gene, enh order by local desc, domain) place from loc",
    "best": "select gene, enh, max(case when place = 1 then local end) max_regional_concordance, max(case when place = 1 then domain end) best_domain, max(case when place = 1 then n end) best_domain_size, coalesce(quantile_cont(case when place > 1 then local end, .5), 0) mo from rk group by all",
    "adv": "select *, round(max_regional_concordance - global_concordance, 6) + 0.0 local_advantage, round(max_regional_concordance - mo, 6) + 0.0 regional_specificity from best join glo using (gene, enh)",
    "ev": "select gene, enh, max_regional_concordance, best_domain, best_domain_size, global_concordance, local_advantage, regional_specificity, round(greatest(max_regional_concordance, 0) * greatest(local_advantage, 0) * greatest(regional_specificity, 0), 6) + 0.0 regional_evidence_score from adv",
    "cl": "select *, case when global_concordance >= .35 then 'core_concordant' when max_regional_concordance >= .2 and regional_evidence_score >= .005 then 'regional_candidate' else 'unsupported' end predicted_class from ev",
}


def _complexity(src: str, keys: str) -> dict[str, str]:
    return {
        "pl": f"select *, case when predicted_class = 'regional_candidate' then row_number() over (partition by {keys} order by (predicted_class = 'regional_candidate')::int desc, regional_evidence_score desc, enh) end place from {src}",
        "td": f"select {keys}, best_domain, count(*) k, sum(regional_evidence_score) s from pl where place <= 5 group by all",
        "dv": f"select {keys}, round(sum(s), 6) + 0.0 es, round(case when count(*) <= 1 then 0 else (ln(sum(k)::double) - sum(k * ln(k::double)) / sum(k)) / ln(count(*)::double) end, 6) + 0.0 dd from td group by all",
        "cn": f"select {keys}, count(*) n_enhancers, count_if(predicted_class = 'core_concordant') n_core, count_if(predicted_class = 'regional_candidate') n_regional_candidates, count_if(predicted_class = 'unsupported') n_unsupported, count(distinct case when predicted_class = 'regional_candidate' then best_domain end) n_supported_domains from {src} group by all",
        "gc": f"select cn.*, coalesce(es, 0.0) regional_evidence_topk_sum, coalesce(dd, 0.0) domain_diversity, round(coalesce(es, 0) * ln(1 + n_regional_candidates) * (1 + coalesce(dd, 0)), 6) + 0.0 complexity_score from cn left join dv using ({keys})",
    }


def _screen(s, d):
    return E.classify(E.evidence(A.paired(s, d)))


@query("COR-06 COR-02 TOP-07 WIN-06 PRJ-12", "paired", "select * from cl", EV)
def evidence_screen(s, d):
    return _screen(s, d)


@query("AGG-05 AGG-06 AGG-07", "paired", "select * from gc", EV | _complexity("cl", "gene"))
def gene_complexity(s, d):
    return E.gene_complexity(_screen(s, d), ["gene"])


@query("WIN-01 AGG-25 AGG-01", "paired", "select *, row_number() over (order by complexity_score desc, n_regional_candidates desc, n_core desc, gene) screen_rank from gc", EV | _complexity("cl", "gene"))
def evidence_screen_rank(s, d):
    order = [F.desc("complexity_score"), F.desc("n_regional_candidates"), F.desc("n_core"), F.col("gene")]
    return E.ranked(E.gene_complexity(_screen(s, d), ["gene"]), order, "screen_rank").withColumn("screen_rank", F.col("screen_rank").cast("long"))


# ---- permutation: observations fill a torus of 25 columns by their id ----
_PERMS, _COLS = 99, 25
_PIX = {
    "side": f"select ((max(obs_id) + {_COLS}) // {_COLS})::int h from obs",
    "pix": f"select gene, enh, (obs_id // {_COLS})::int \"row\", (obs_id % {_COLS})::int col, (obs_id // {_COLS} * 2 >= h)::int * 3 + (obs_id % {_COLS} * 3 // {_COLS})::int domain, x, y from paired, side",
    "sums": f"select gene, enh, domain, {_SUMS} from pix group by all",
    "loc": f"select gene, enh, domain, n, {_R.format(_COR.format(eps='1e-8', more='and n >= 8'))} local from sums",
    "glo": EV["glo"].replace(_CORR, _R.format(_COR.format(eps="1e-8", more="and n >= 8"))),
    **{k: EV[k] for k in ("rk", "best", "adv", "ev")},
    "perm": f"select p perm, (7 * p + 3) % h dy, (11 * p + 5) % {_COLS} dx from (select unnest(range({_PERMS})) p), side",
    "nsum": f"select gene, enh, perm, domain, {_SUMS} from (select a.gene, a.enh, perm, b.domain, a.x, b.y from pix a, perm, side, pix b where a.gene = b.gene and a.enh = b.enh and b.row = (a.row + dy) % h and b.col = (a.col + dx) % {_COLS}) group by all",
    "nmax": f"select gene, enh, perm, max({_R.format(_COR.format(eps='1e-8', more='and n >= 8'))}) m from nsum group by all",
    "hit": "select ev.gene, ev.enh, count_if(m >= max_regional_concordance) k from ev join nmax using (gene, enh) group by all",
    "pv": f"select ev.*, (1 + coalesce(k, 0)) / {_PERMS + 1}.0::double permutation_pvalue from ev left join hit using (gene, enh)",
    "bh": "select *, permutation_pvalue * count(*) over (partition by gene) / row_number() over (partition by gene order by permutation_pvalue) b from pv",
    "qv": "select * exclude (b), round(least(1.0::double, min(b) over (partition by gene order by permutation_pvalue range between current row and unbounded following)), 6) + 0.0 permutation_qvalue from bh",
    "cl2": "select *, case when global_concordance >= .35 then 'core_concordant' when max_regional_concordance >= .2 and regional_evidence_score >= .005 and permutation_qvalue <= .1 then 'regional_candidate' else 'unsupported' end predicted_class from qv",
    "fin": "select * replace (round(regional_evidence_score * (1 - permutation_qvalue), 6) + 0.0 as regional_evidence_score) from cl2",
}


def _torus(s, d):
    """All pairs on the torus, and its number of rows; the last row may be incomplete."""
    height = A.observations(s, d).agg(F.max("obs_id")).first()[0] // _COLS + 1
    row, col = (F.col("obs_id") / _COLS).cast("int"), (F.col("obs_id") % _COLS).cast("int")
    domain = (2 * row >= height).cast("int") * 3 + (col * 3 / _COLS).cast("int")
    return A.paired(s, d).select("gene", "enh", row.alias("row"), col.alias("col"), domain.alias("domain"), "x", "y"), height


def _confirmed(s, d):
    """Evidence on the torus with the p- and q-values of all shifts."""
    pix, height = _torus(s, d)
    shifts = [((7 * p + 3) % height, (11 * p + 5) % _COLS) for p in range(_PERMS)]
    return E.permutation_p(E.evidence(pix, policy="zero_std"), E.toroidal_null(pix, shifts, height, _COLS), E.KEYS, _PERMS)


@query("COR-07 COR-09 COR-01 WIN-04", "paired", "select * from fin", _PIX)
def permutation_evidence(s, d):
    classed = E.classify(_confirmed(s, d), with_q=True)
    return classed.withColumn("regional_evidence_score", r(F.col("regional_evidence_score") * (1 - F.col("permutation_qvalue"))))


_THR = {"th": "select unnest([.20, .25, .30, .35])::double core_threshold"}
# The screen's tables keep their names, the permutation stage's get a prefix.
_STAGE2 = {f"p_{k}": re.sub(rf"\b({'|'.join(_PIX)})\b(?=[ ,.)]|$)(?! \w+_)", lambda m: f"p_{m[1]}", v) for k, v in _PIX.items()}
_SRCI = EV | _STAGE2 | {
    "conf": "select gene, enh, permutation_qvalue q from p_qv",
    "jn": "select cl.* exclude (predicted_class), coalesce(q, 1.0::double) permutation_qvalue from cl left join conf using (gene, enh)",
    **_THR,
    "lg": "select *, case when global_concordance >= core_threshold then 'core_concordant' when max_regional_concordance >= .2 and regional_evidence_score >= .005 and permutation_qvalue <= .1 then 'regional_candidate' else 'unsupported' end predicted_class from jn, th",
    **_complexity("lg", "gene, core_threshold"),
    "mx": "select *, case when n_core >= 1 and n_regional_candidates >= 1 then complexity_score else 0 end mixed from gc",
    "piv": "select gene, sum(round(mixed * 1e6)::bigint)::bigint / 4e6::double srci, count_if(mixed > 0) threshold_stability, max(case when core_threshold = .35::double then n_core end) n_core_strict, max(case when core_threshold = .35::double then n_regional_candidates end) n_regional_strict from mx group by gene",
    "qs": "select gene, count_if(permutation_qvalue <= .1) n_q010_enhancers, min(permutation_qvalue) min_enhancer_q from jn group by gene",
    "ex": "select gene, round(avg(y), 6) + 0.0 rna_mean, round(count_if(y > 0)::double / count(*), 6) + 0.0 rna_detected_fraction from targets group by gene",
    "src": "select piv.*, n_q010_enhancers, min_enhancer_q, rna_mean, rna_detected_fraction, row_number() over (order by srci desc, n_regional_strict desc, n_core_strict desc, gene) srci_rank from piv left join qs using (gene) left join ex using (gene)",
    "cu": "select srci_rank k, log10(srci + 1e-6) t, row_number() over (order by srci_rank) i, count(*) over () n, first_value(log10(srci + 1e-6)) over (order by srci_rank) top, last_value(log10(srci + 1e-6)) over (order by srci_rank rows between unbounded preceding and unbounded following) e from src where srci > 0",
    "el": "select case when coalesce(max(n), 0) < 3 then coalesce(max(n), 0) else arg_max(i, (round((1 - (i - 1)::double / greatest(n - 1, 1)) - (t - e) / greatest(top - e, 1e-12), 9), -i)) end elbow from cu",
}


def _srci(s, d):
    screened = _screen(s, d)
    confirmed = _confirmed(s, d).select("gene", "enh", F.col("permutation_qvalue").alias("q"))
    joined = cut(screened.drop("predicted_class").join(confirmed, E.KEYS, "left").withColumn("permutation_qvalue", F.coalesce("q", F.lit(1.0))).drop("q"))
    thresholds = s.createDataFrame([(x,) for x in (0.20, 0.25, 0.30, 0.35)], "core_threshold double")
    at_all = joined.crossJoin(F.broadcast(thresholds))
    regional = (F.col("max_regional_concordance") >= 0.2) & (F.col("regional_evidence_score") >= 0.005) & (F.col("permutation_qvalue") <= 0.1)
    classed = at_all.withColumn("predicted_class", F.when(F.col("global_concordance") >= F.col("core_threshold"), "core_concordant").when(regional, "regional_candidate").otherwise("unsupported"))
    scored = E.gene_complexity(classed, ["gene", "core_threshold"])
    mixed = scored.withColumn("mixed", F.when((F.col("n_core") >= 1) & (F.col("n_regional_candidates") >= 1), F.col("complexity_score")).otherwise(0.0))
    wide = mixed.groupBy("gene").pivot("core_threshold", [0.20, 0.25, 0.30, 0.35]).agg(F.max("mixed").alias("m"), F.max("n_core").alias("c"), F.max("n_regional_candidates").alias("g")).fillna(0.0)
    scores = [F.col(f"`{t}_m`") for t in ("0.2", "0.25", "0.3", "0.35")]
    source = wide.select(
        "gene", (sum((F.round(x * 1e6).cast("long") for x in scores), F.lit(0)) / 4e6).alias("srci"), sum(((x > 0).cast("long") for x in scores), F.lit(0)).cast("long").alias("threshold_stability"),
        F.col("`0.35_c`").alias("n_core_strict"), F.col("`0.35_g`").alias("n_regional_strict"),
    )
    q = joined.groupBy("gene").agg(F.count_if(F.col("permutation_qvalue") <= 0.1).alias("n_q010_enhancers"), F.min("permutation_qvalue").alias("min_enhancer_q"))
    audit = A.targets(s, d).groupBy("gene").agg(r(F.avg("y")).alias("rna_mean"), r(F.count_if(F.col("y") > 0) / F.count(F.lit(1))).alias("rna_detected_fraction"))
    full = source.join(q, "gene", "left").join(audit, "gene", "left")
    return E.ranked(full, [F.desc("srci"), F.desc("n_regional_strict"), F.desc("n_core_strict"), F.col("gene")], "srci_rank").withColumn("srci_rank", F.col("srci_rank").cast("long"))


@query("REL-03 REL-04 REL-18 AGG-08 AGG-09 AGG-17 SET-01", "paired targets", "select * from src", _SRCI)
def srci_source(s, d):
    return _srci(s, d)


@query("WIN-07", "paired targets", "select elbow::bigint elbow from el", _SRCI)
def srci_elbow(s, d):
    return E.elbow(_srci(s, d), "srci_rank", "srci")


@query("PRJ-18", "paired targets", "select gene, n_core_strict >= 1 and n_regional_strict >= 2 and threshold_stability >= 3 and rna_detected_fraction >= .1 confirmed_mixed, threshold_stability >= 2 and rna_detected_fraction >= .1 threshold_stable_mixed, srci_rank <= (select elbow from el) above_elbow from src", _SRCI)
def srci_flags(s, d):
    source = _srci(s, d)
    detected = F.col("rna_detected_fraction") >= 0.1
    return source.crossJoin(F.broadcast(E.elbow(source, "srci_rank", "srci"))).select(
        "gene", ((F.col("n_core_strict") >= 1) & (F.col("n_regional_strict") >= 2) & (F.col("threshold_stability") >= 3) & detected).alias("confirmed_mixed"),
        ((F.col("threshold_stability") >= 2) & detected).alias("threshold_stable_mixed"), (F.col("srci_rank") <= F.col("elbow")).alias("above_elbow"),
    )


@query("FIG-01", "paired targets", "select srci_rank, gene, srci, log10(srci + 1e-6) is not null finite, n_core_strict, n_regional_strict, n_q010_enhancers from src where srci_rank <= 20", _SRCI)
def srci_curve(s, d):
    return _srci(s, d).where("srci_rank <= 20").select("srci_rank", "gene", "srci", F.log10(F.col("srci") + 1e-6).isNotNull().alias("finite"), "n_core_strict", "n_regional_strict", "n_q010_enhancers")


@query("FIG-02 STR-08", "paired", """select gene, 'C' || row_number() over (partition by gene order by global_concordance desc, enh) panel_id, enh, global_concordance shown from (select *, row_number() over (partition by gene order by global_concordance desc, enh) k from cl where predicted_class = 'core_concordant') where k <= 3
union all select gene, 'R' || row_number() over (partition by gene order by regional_evidence_score desc, enh), enh, regional_evidence_score from (select *, row_number() over (partition by gene order by regional_evidence_score desc, enh) k from cl where predicted_class = 'regional_candidate') where k <= 3""", EV)
def top_core_and_regional(s, d):
    classed = _screen(s, d)
    out = None
    for kind, letter, by in (("core_concordant", "C", "global_concordance"), ("regional_candidate", "R", "regional_evidence_score")):
        part = classed.where(F.col("predicted_class") == kind).withColumn("k", pick([F.desc(by), F.col("enh")], ["gene"])).where("k <= 3")
        part = part.select("gene", F.concat(F.lit(letter), F.col("k")).alias("panel_id"), "enh", F.col(by).alias("shown"))
        out = part if out is None else out.unionByName(part)
    return out


@query("COR-03", "paired", "select gene, enh, round(case when count(*) >= 3 and stddev_pop(x) >= 1e-8 and stddev_pop(y) >= 1e-8 then covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) end, 6) + 0.0 rho from paired where x > 0.2 and y > 0.25 group by all")
def finite_correlation(s, d):
    return A.paired(s, d).where("x > 0.2 and y > 0.25").groupBy("gene", "enh").agg(*moments("x", "y")).select("gene", "enh", r(correlation("null")).alias("rho"))


_SPEAR = {
    "rks": "select gene, enh, rank() over (partition by gene, enh order by x) + (count(*) over (partition by gene, enh, x) - 1) / 2.0::double rx, rank() over (partition by gene, enh order by y) + (count(*) over (partition by gene, enh, y) - 1) / 2.0::double ry from paired",
    "rho": "select gene, enh, count(*) n, round(case when stddev_pop(rx) >= 1e-8 and stddev_pop(ry) >= 1e-8 then covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) else 0 end, 6) + 0.0 rho from rks group by all",
}


#: Rows of a value of a target from which its rank is broadcast.
_HOT = 1000


def _spearman(s, d):
    # A target's ranks are the same for all its drivers: they are made once, before drivers become rows. Values of many rows are few.
    own, own_sizes, _ = sliced(A.targets(s, d).select("gene", "y"), "y", ["gene"])
    own = cut(centred_ranks(own.groupBy("gene", "_slice", "y").agg(F.count(F.lit(1)).alias("c")), own_sizes, "y", ["gene"], "c", "ry"))
    hot, rare = (own.where(f"c {op} {_HOT}").select("gene", "y", "ry") for op in (">", "<="))
    rows = A.signals(s, d).select("gene", "y", "x").join(F.broadcast(hot), ["gene", "y"], "left")
    rows = rows.where("ry is not null").unionByName(rows.where("ry is null").drop("ry").join(rare, ["gene", "y"]).select("gene", "y", "x", "ry"))
    _, sizes, place = sliced(A.signals(s, d).select("gene", F.posexplode("x").alias("enh", "x")), "x", ["gene", "enh"])
    # The same slices over rows with their target's rank; equal values share a rank, so a value's sums are all that a correlation needs.
    with_rank = place(rows.select("gene", "ry", F.posexplode("x").alias("enh", "x")))
    values = with_rank.groupBy("gene", "enh", "_slice", "x").agg(F.count(F.lit(1)).alias("c"), F.sum("ry").alias("sy"), F.sum(F.col("ry") * F.col("ry")).alias("syy"))
    ranks = centred_ranks(values, sizes, "x", ["gene", "enh"], "c", "rx")
    sums = ranks.groupBy("gene", "enh").agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("rx") * F.col("rx")) / F.sum("c")).alias("vx"), (F.sum("syy") / F.sum("c")).alias("vy"), (F.sum(F.col("rx") * F.col("sy")) / F.sum("c")).alias("cxy"))
    return sums.select("gene", "enh", "n", r(F.coalesce(correlation("null"), F.lit(0.0))).alias("rho"))


@query("COR-04 WIN-02", "paired", "select * from rho", _SPEAR)
def spearman_links(s, d):
    return _spearman(s, d)


@query("COR-05", "paired", "select gene, enh, rho, round(least(greatest(rho, -1 + 1e-9), 1 - 1e-9) * sqrt((n - 2) / (1 - pow(least(greatest(rho, -1 + 1e-9), 1 - 1e-9), 2))), 4) + 0.0 t_stat from rho", _SPEAR)
def t_statistics(s, d):
    clipped = F.least(F.greatest(F.col("rho"), F.lit(-1 + 1e-9)), F.lit(1 - 1e-9))
    return _spearman(s, d).select("gene", "enh", "rho", r(clipped * F.sqrt((F.col("n") - 2) / (1 - clipped * clipped)), 4).alias("t_stat"))


@query("COR-05")
def one_tailed_p_values(s, d):
    from terrane.functions.student import upper_tail

    clipped = F.least(F.greatest(F.col("rho"), F.lit(-1 + 1e-9)), F.lit(1 - 1e-9))
    t = _spearman(s, d).withColumn("t_stat", clipped * F.sqrt((F.col("n") - 2) / (1 - clipped * clipped)))
    return t.select("gene", "enh", "rho", "t_stat", upper_tail(F.col("t_stat"), F.col("n") - 2).alias("p")).withColumn("significant", F.col("p") < 0.01)


@query("AGG-20", "paired", """select round(count_if(p and t)::double / greatest(count_if(p), 1), 6) regional_precision, round(count_if(p and t)::double / greatest(count_if(t), 1), 6) regional_recall,
round(count_if(p and not t)::double / greatest(count_if(p), 1), 6) regional_fdr, round(count_if(predicted_class = 'core_concordant' and enh % 4 = 0)::double / greatest(count_if(enh % 4 = 0), 1), 6) core_recall from (select *, predicted_class = 'regional_candidate' p, enh % 4 = 1 t from cl)""", EV)
def recovery_metrics(s, d):
    p, t = F.col("predicted_class") == "regional_candidate", F.col("enh") % 4 == 1
    over = lambda a, b: F.round(F.count_if(a) / F.greatest(F.count_if(b), F.lit(1)), 6)
    core = F.col("enh") % 4 == 0
    return _screen(s, d).agg(over(p & t, p).alias("regional_precision"), over(p & t, t).alias("regional_recall"), over(p & ~t, p).alias("regional_fdr"), over((F.col("predicted_class") == "core_concordant") & core, core).alias("core_recall"))


@query("AGG-21", "paired", """select round(sum((tp - lag_tp) * tp / n) / max(pos), 6) average_precision from (select score, tp, n, coalesce(lag(tp) over (order by score desc), 0) lag_tp, max(tp) over () pos from
(select score, sum(sum(t)) over (order by score desc) tp, sum(count(*)) over (order by score desc) n from (select regional_evidence_score score, (enh % 4 = 1)::int t from cl) group by score))""", EV)
def average_precision(s, d):
    """Precision at each score, over the true drivers found there; scores have six digits, so they are whole numbers of millionths."""
    score = (-F.round(F.col("regional_evidence_score") * 1e6)).cast("long")
    by_score = cut(_screen(s, d).groupBy(score.alias("k")).agg(F.sum((F.col("enh") % 4 == 1).cast("long")).alias("t"), F.count(F.lit(1)).alias("c")))
    steps = prefix_sums(by_score, "k", "t", "hits").join(prefix_sums(by_score.select("k", "c"), "k", "c", "rows").drop("c"), "k")
    return steps.agg(F.round(F.sum(F.col("t") * (F.col("hits") + F.col("t")) / (F.col("rows") + F.col("c"))) / F.sum("t"), 6).alias("average_precision"))


@query("AGG-22 AGG-23", "paired", "select predicted_class, count(*) n, round(avg(regional_evidence_score), 6) + 0.0 mean, round(stddev_samp(regional_evidence_score), 6) + 0.0 std, min(regional_evidence_score) lo, max(regional_evidence_score) hi from cl group by predicted_class", EV)
def class_summary(s, d):
    v = "regional_evidence_score"
    return _screen(s, d).groupBy("predicted_class").agg(F.count(F.lit(1)).alias("n"), r(F.avg(v)).alias("mean"), r(F.stddev_samp(v)).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"))


@query("AGG-23", "paired", "select a.gene, a.enh, round(sum(round((a.local - b.local) * 1e6)::bigint)::double / count(*)) / 1e6::double + 0.0 mean_gain, round(min(a.local - b.local), 6) + 0.0 min_gain, round(max(a.local - b.local), 6) + 0.0 max_gain, round(avg((a.local > b.local)::int), 6) + 0.0 share from loc a join loc b on a.gene = b.gene and a.domain = b.domain and a.enh > 0 and b.enh = 0 group by a.gene, a.enh", EV)
def paired_gains(s, d):
    """Gains by domain of every driver over the first one."""
    local = E.domain_moments(A.paired(s, d)).select("gene", "enh", "domain", r(E.from_moments()).alias("local"))
    first = F.max(F.when(F.col("enh") == 0, F.col("local"))).over(Window.partitionBy("gene", "domain"))
    both = local.withColumn("g", F.col("local") - first).where("enh > 0")
    mean = F.round(F.sum(F.round(F.col("g") * 1e6).cast("long")) / F.count(F.lit(1))) / 1e6 + F.lit(0.0)
    return both.groupBy("gene", "enh").agg(mean.alias("mean_gain"), r(F.min("g")).alias("min_gain"), r(F.max("g")).alias("max_gain"), r(F.avg((F.col("g") > 0).cast("int"))).alias("share"))


# ---- shifts in three dimensions: 99 random ones, from a seed ----
_BOX_PERMS, _BOX_SEED = 99, 31
_SHIFTS = random_shifts(_BOX_PERMS, 3, _BOX_SEED)
_BOX = {
    "box": "select obs_id, least((x - min(x) over ()) / greatest(max(x) over () - min(x) over (), 1e-8), 0.9999999999999999::double) u, least((y - min(y) over ()) / greatest(max(y) over () - min(y) over (), 1e-8), 0.9999999999999999::double) v, least((z - min(z) over ()) / greatest(max(z) over () - min(z) over (), 1e-8), 0.9999999999999999::double) w from obs",
}
_NULL = _BOX | {
    "shift": "select * from (values " + ", ".join(f"({k}, {u!r}::double, {v!r}::double, {w!r}::double)" for k, (u, v, w) in enumerate(_SHIFTS.tolist())) + ") t(perm, mu, mv, mw)",
    "went": "select perm, obs_id, fmod(u + mu, 1) u2, fmod(v + mv, 1) v2, fmod(w + mw, 1) w2 from box, shift",
    "via": "select perm, went.obs_id, arg_min(o.obs_id, (round(least(abs(o.u - u2), 1 - abs(o.u - u2))**2 + least(abs(o.v - v2), 1 - abs(o.v - v2))**2 + least(abs(o.w - w2), 1 - abs(o.w - w2))**2, 9), o.obs_id)) src from went, box o group by perm, went.obs_id",
    "nsums": f"select b.gene, b.enh, perm, b.domain, count(*) n, sum(a.x) sx, sum(b.y) sy, sum(a.x * a.x) sxx, sum(b.y * b.y) syy, sum(a.x * b.y) sxy from via join paired b using (obs_id) join paired a on a.obs_id = via.src and a.gene = b.gene and a.enh = b.enh group by all",
    "nmaxima": f"select gene, enh, perm, max({_CORR}) m from nsums group by all",
    "nhit": "select ev.gene, ev.enh, count_if(m >= max_regional_concordance) k from ev join nmaxima using (gene, enh) group by all",
    "npv": f"select ev.*, (1 + coalesce(k, 0)) / {_BOX_PERMS + 1}.0::double permutation_pvalue from ev left join nhit using (gene, enh)",
    "nbh": "select *, permutation_pvalue * count(*) over (partition by gene) / row_number() over (partition by gene order by permutation_pvalue) b from npv",
    "nqv": "select * exclude (b), round(least(1.0::double, min(b) over (partition by gene order by permutation_pvalue range between current row and unbounded following)), 6) + 0.0 permutation_qvalue from nbh",
}


def _box(s, d):
    return unit_box(A.observations(s, d).select("obs_id", "x", "y", "z"), ["x", "y", "z"])


@query("REL-16", "obs", "select src.obs_id, arg_min(o.obs_id, (round(least(abs(o.u - src.u2), 1 - abs(o.u - src.u2))**2 + least(abs(o.v - src.v2), 1 - abs(o.v - src.v2))**2 + least(abs(o.w - src.w2), 1 - abs(o.w - src.w2))**2, 9), o.obs_id)) nearest from src, box o group by src.obs_id", _BOX | {
    "src": "select obs_id, fmod(u + 0.3::double, 1) u2, fmod(v + 0.45::double, 1) v2, fmod(w + 0.7::double, 1) w2 from box",
})
def toroidal_nearest(s, d):
    """Periodic nearest neighbours of all observations, shifted through the unit box."""
    found = shifted_sources(_box(s, d), "obs_id", ["x", "y", "z"], np.array([[0.3, 0.45, 0.7]]))
    return found.select(F.col("obs").alias("obs_id"), F.col("src").alias("nearest"))


@query("COR-08 REL-16 COR-09 WIN-04", "paired obs", "select * from nqv", EV | _NULL)
def periodic_null_evidence(s, d):
    """Evidence with p- and q-values from 99 shifts in three dimensions; classes are left to the ranking."""
    signals = A.signals(s, d).withColumnRenamed("obs_id", "obs")
    sources = shifted_sources(_box(s, d), "obs_id", ["x", "y", "z"], _SHIFTS)
    return E.permutation_p(E.evidence(A.paired(s, d)), shifted_null(signals, sources, _BOX_PERMS), E.KEYS, _BOX_PERMS)
