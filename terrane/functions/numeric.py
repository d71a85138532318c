"""Numeric expressions: guarded statistics, ranks and adjusted p-values.

Statistics are written as moments (sums of products), which combine on the map side; ``corr`` and
``regr_*`` aren't used, as they fail or give NaN on constant columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def r(value: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits) + F.lit(0.0)


def moments(x: str, y: str, prefix: str = "") -> list[Column]:
    """n, means, population (co)variances of a pair of columns; rows with a null in either don't count."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    return [
        F.count(F.when(both, 1)).alias(f"{prefix}n"), F.avg(a).alias(f"{prefix}mx"), F.avg(b).alias(f"{prefix}my"),
        F.covar_pop(a, b).alias(f"{prefix}cxy"), F.var_pop(a).alias(f"{prefix}vx"), F.var_pop(b).alias(f"{prefix}vy"),
    ]


def correlation(policy: str = "zero", prefix: str = "", min_n: int | None = None) -> Column:
    """Pearson's r from ``moments`` under a policy for degenerate input.

    zero_std: 0 if n < 8 or a deviation is under 1e-8; zero: 0 if the root of the product of the sums of
    squares is at most 1e-12; null: null if n < 3 or a deviation is under 1e-8.
    """
    n, c, vx, vy = (F.col(f"{prefix}{k}") for k in ("n", "cxy", "vx", "vy"))
    value = c / F.sqrt(vx * vy)
    if policy == "zero":
        return F.when(F.sqrt(vx * vy) * n > 1e-12, value).otherwise(0.0)
    good = (n >= (min_n if min_n is not None else 8 if policy == "zero_std" else 3)) & (F.sqrt(vx) >= 1e-8) & (F.sqrt(vy) >= 1e-8)
    return F.when(good, value).otherwise(F.lit(0.0) if policy == "zero_std" else F.lit(None).cast("double"))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 within groups, ties getting their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def adjusted(p: str, by: list[str]) -> Column:
    """Benjamini-Hochberg q-values within groups; equal p share the least."""
    return F.least(F.lit(1.0), F.min("_bh").over(Window.partitionBy(*by).orderBy(p).rangeBetween(Window.currentRow, Window.unboundedFollowing)))


def with_q_values(frame: DataFrame, p: str, by: list[str], out: str) -> DataFrame:
    """``frame`` with the q-values of column ``p`` in column ``out``."""
    groups = Window.partitionBy(*by)
    raw = F.col(p) * F.count(F.lit(1)).over(groups) / F.row_number().over(groups.orderBy(p))
    return frame.withColumn("_bh", raw).withColumn(out, adjusted(p, by)).drop("_bh")


def pick(order: list[Column], by: list[str]) -> Column:
    """Place of a row in its group."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def entropy(counts: str) -> Column:
    """Normalised entropy (0 to 1) of a group's counts, as an aggregate; 0 with fewer than two categories."""
    total, k = F.sum(counts), F.count(F.lit(1))
    return F.when(k <= 1, 0.0).otherwise((F.log(total.cast("double")) - F.sum(F.col(counts) * F.log(F.col(counts).cast("double"))) / total) / F.log(k.cast("double")))


def whole() -> WindowSpec:
    """All rows as one group; for frames that are small by construction (one row a gene or a threshold)."""
    return Window.partitionBy()
