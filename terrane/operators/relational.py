"""Relational operators with the reference data model's rules: scans with contracts, picks and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.numeric import pick


def require_columns(frame: DataFrame, names: list[str]) -> DataFrame:
    """``frame``, if it has the columns; else ValueError."""
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return frame


def missing_features(requested: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Requested names that aren't known."""
    return requested.join(known.select(on).distinct(), on, "left_anti")


def read_features(cells: DataFrame, requested: list[int], var: str = "var_id") -> DataFrame:
    """Cells of the requested variables with their place in the request; KeyError if one is unknown.

    The request is a literal list, so the filter reaches the scan.
    """
    known = {r[0] for r in cells.where(F.col(var).isin(requested)).select(var).distinct().collect()}
    if unknown := [v for v in requested if v not in known]:
        raise KeyError(f"unknown features: {unknown}")
    place = F.array_position(F.array(*[F.lit(v) for v in requested]), F.col(var)) - 1
    return cells.where(F.col(var).isin(requested)).withColumn("place", place.cast("int"))


def read_links(links: DataFrame, targets: DataFrame, regions: DataFrame, top_k: int = 20, score: str = "importance_x_abs_rho") -> DataFrame:
    """Links of known targets and regions, one a pair, the best ``top_k`` of each target; a missing score counts as 0."""
    require_columns(links, ["target", "region"])
    scored = links if score in links.columns else links.withColumn(score, F.lit(0.0))
    known = scored.join(targets, "target", "left_semi").join(regions, "region", "left_semi")
    one = known.withColumn("_k", pick([F.col(score).desc_nulls_last()], ["target", "region"])).where("_k = 1").drop("_k")
    return top_per_group(one, ["target"], [F.col(score).desc_nulls_last(), F.col("region")], top_k)


def top_per_group(frame: DataFrame, by: list[str], order: list[Column], k: int, out: str | None = None) -> DataFrame:
    """The first k rows of each group; Spark limits each group before the shuffle."""
    placed = frame.withColumn("_place", pick(order, by)).where(F.col("_place") <= k)
    return placed.withColumnRenamed("_place", out) if out else placed.drop("_place")


def filter_links(links: DataFrame, targets: DataFrame, min_rho: float = 0.05, min_links: int = 5) -> DataFrame:
    """Complete links of known targets with importance and correlation, of targets that keep enough of them."""
    good = links.dropna(subset=["target", "region", "importance", "rho", "distance"]).join(targets, "target", "left_semi")
    good = good.where((F.col("importance") > 0) & (F.abs("rho") >= min_rho))
    sizes = good.groupBy("target").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_links)
    return good.join(sizes.select("target"), "target", "left_semi")


def parse_gtf(lines: DataFrame) -> DataFrame:
    """gene, chrom, start, end, strand, tss and line of gene records of annotation lines (line long, value).

    Comment lines and lines of under nine fields are skipped; the TSS is the end on the minus strand.
    """
    fields = lines.where("not startswith(value, '#')").select("line", F.split("value", "\t").alias("f")).where("size(f) >= 9 and f[2] = 'gene'")
    return fields.select(
        "line", F.regexp_extract(F.col("f")[8], 'gene_name "([^"]+)"', 1).alias("gene"), F.col("f")[0].alias("chrom"), F.expr("try_cast(f[3] as bigint)").alias("start"),
        F.expr("try_cast(f[4] as bigint)").alias("end"), F.col("f")[6].alias("strand"), F.expr("try_cast(if(f[6] = '-', f[4], f[3]) as bigint)").alias("tss"),
    ).where("gene <> ''")


def first_records(records: DataFrame, last: bool = False) -> DataFrame:
    """One record a gene: the first by line, or the last."""
    order = F.col("line").desc() if last else F.col("line")
    return records.withColumn("_k", pick([order], ["gene"])).where("_k = 1").drop("_k")


def parse_interval(text: Column, strict: bool = False) -> Column:
    """struct(chrom, start, end, width, center) of ``chrom:start-end`` or ``chrom-start-end``; null (or an error) otherwise."""
    pattern = r"^([^:\-]+)[:\-](\d+)-(\d+)$"
    start, end = F.regexp_extract(text, pattern, 2).cast("bigint"), F.regexp_extract(text, pattern, 3).cast("bigint")
    made = F.struct(F.regexp_extract(text, pattern, 1).alias("chrom"), start.alias("start"), end.alias("end"), (end - start).alias("width"), F.floor((start + end) / 2).alias("center"))
    other = F.raise_error(F.concat(F.lit("not an interval: "), text)).cast("struct<chrom:string,start:bigint,end:bigint,width:bigint,center:bigint>") if strict else F.lit(None)
    return F.when(text.rlike(pattern), made).otherwise(other)


def layered(measured: DataFrame, imputed: DataFrame, wanted: DataFrame, on: list[str], value: str) -> DataFrame:
    """The measured value, else the imputed one, else null, with its source named."""
    m, i = measured.select(*on, F.col(value).alias("_m")), imputed.select(*on, F.col(value).alias("_i"))
    joined = wanted.join(m, on, "left").join(i, on, "left")
    source = F.when(F.col("_m").isNotNull(), "measured").when(F.col("_i").isNotNull(), "imputed").otherwise("missing")
    return joined.select(*on, F.coalesce("_m", "_i").alias(value), source.alias("source"))


def pending(wanted: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """What a ledger doesn't list as readable or blocked yet; errors are tried again."""
    return wanted.join(done.where("status in ('readable', 'blocked')"), on, "left_anti")
