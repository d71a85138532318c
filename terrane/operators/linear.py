"""Linear models from moments: one pass of Spark gathers a Gram matrix a group, models are solved in tasks, a target each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features of a model whose Gram matrix is gathered by SQL sums and reaches the driver.
MAX_FEATURES = 32


def grams(rows: DataFrame, features: list[str], target: str, by: str | None = None) -> dict:
    """Gram matrix of (1, features, target) for each value of ``by`` (None: one for all)."""
    if len(features) > MAX_FEATURES:
        raise ValueError(f"at most {MAX_FEATURES} features")
    names = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    upper = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = rows.groupBy(*([by] if by else [])).agg(*[F.sum(names[i] * names[j]).alias(f"g{i}_{j}") for i, j in upper]).collect()
    out = {}
    for row in got:
        g = np.zeros((len(names), len(names)))
        for i, j in upper:
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
        out[row[by] if by else None] = g
    return out


def gram_rows(rows: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """by and gram: the Gram matrix of (1, x, y) of each group, row by row as one array; x is an array of one length a group.

    Tasks add up what they see, a matrix a group, and a group's matrices are added: no group's rows come together.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by) + ", gram array<double>"

    def partial(frames):
        sums: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for key, part in frame.groupby(by, sort=False, dropna=False):
                z = np.column_stack([np.ones(len(part)), np.stack(part[x]).astype(float), part[y].to_numpy(float)])
                sums[key] = sums[key] + z.T @ z if key in sums else z.T @ z
            if len(sums) > 1000:
                yield pd.DataFrame([(*k, g.ravel()) for k, g in sums.items()], columns=[*by, "gram"])
                sums = {}
        yield pd.DataFrame([(*k, g.ravel()) for k, g in sums.items()], columns=[*by, "gram"])

    def add(frame):
        return frame.iloc[:1].assign(gram=[np.sum(np.stack(frame["gram"]), axis=0)])

    return rows.select(*by, x, y).mapInPandas(partial, kinds).groupBy(*by).applyInPandas(add, kinds)


def by_domain(grams: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of (1, all features, their products with each domain's indicator, target) from the domains' own matrices.

    Products with different domains' indicators vanish, so nothing else is needed.
    """
    whole = sum(grams)
    k, n = len(whole) - 2, len(grams)
    out = np.zeros((k * (n + 1) + 2,) * 2)
    shared, last = np.arange(k + 1), k * (n + 1) + 1
    out[np.ix_([*shared, last], [*shared, last])] = whole
    for d, g in enumerate(grams):
        own = np.arange(k * (d + 1) + 1, k * (d + 2) + 1)
        out[np.ix_(own, own)] = g[1:-1, 1:-1]
        for at, part in (([0], g[:1, 1:-1]), (shared[1:], g[1:-1, 1:-1]), ([last], g[-1:, 1:-1])):
            out[np.ix_(at, own)] = part
            out[np.ix_(own, at)] = part.T
    return out


def solve_groups(grams: DataFrame, group: str, model: Callable[[pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``model`` makes of each group's matrices (column gram: square arrays), in tasks."""

    def solve(frame):
        side = int(round(len(frame["gram"].iloc[0]) ** 0.5))
        return pd.DataFrame(model(frame.assign(gram=[np.asarray(g).reshape(side, side) for g in frame["gram"]])), columns=[x.split()[0] for x in schema.split(", ")])

    return grams.groupBy(group).applyInPandas(solve, schema)


def elastic_net(g: np.ndarray, alpha: float = 1e-3, ratio: float = 0.5, rounds: int = 5000, tol: float = 1e-12) -> tuple[np.ndarray, float]:
    """Nonnegative weights and intercept that minimise 1/(2n) |y - Xw - b|^2 + alpha (ratio |w|_1 + (1 - ratio)/2 |w|^2)."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    a, b = cov[:-1, :-1], cov[:-1, -1]
    w = np.zeros(len(b))
    for _ in range(rounds):
        before = w.copy()
        for k in range(len(w)):
            rest = b[k] - a[k] @ w + a[k, k] * w[k]
            w[k] = max(0.0, rest - alpha * ratio) / (a[k, k] + alpha * (1 - ratio)) if a[k, k] + alpha * (1 - ratio) > 0 else 0.0
        if np.abs(w - before).max(initial=0) < tol:
            break
    return w, float(mean[-1] - mean[:-1] @ w)


def optimality_gap(g: np.ndarray, w: np.ndarray, alpha: float = 1e-3, ratio: float = 0.5) -> float:
    """Largest violation of the conditions that the minimiser meets."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    slope = cov[:-1, -1] - cov[:-1, :-1] @ w - alpha * ratio - alpha * (1 - ratio) * w
    return float(np.max(np.where(w > 0, np.abs(slope), np.maximum(slope, 0)), initial=0.0))


def squared_error(g: np.ndarray, w: np.ndarray, b: float) -> float:
    """Mean squared error on the rows of a Gram matrix."""
    v = np.concatenate([[-b], -w, [1.0]])
    return float(v @ g @ v / max(g[0, 0], 1))


def gate_opens(gains: list[float], policy: str = "robust", min_folds: int = 3, least_mean: float = 0.002, worst: float = 0.01) -> bool:
    """Whether relative gains by fold open a gate.

    strict: every fold improves; majority: ``min_folds`` folds do; robust: these do, the mean gain is at least
    ``least_mean``, and no fold loses more than ``worst``. No folds at all are an error.
    """
    if not gains:
        raise ValueError("a gate needs a fold to be judged by")
    improved = sum(g > 0 for g in gains)
    rules = {"strict": improved == len(gains), "majority": improved >= min_folds, "robust": improved >= min_folds and float(np.mean(gains)) >= least_mean and min(gains) >= -worst}
    if policy not in rules:
        raise ValueError(f"no gate policy is called {policy!r}; there are {', '.join(rules)}")
    return bool(rules[policy])


def nested_gate(per_fold: dict, shared: list[int], spatial: list[int], test_fold, min_folds: int = 3, least_mean: float = 0.002, worst: float = 0.01, alpha: float = 1e-3, policy: str = "robust") -> tuple[bool, list[dict]]:
    """Whether spatial features beat shared ones in nested refits; and a row for each validation fold.

    per_fold: Gram matrices over (1, all features, target); shared and spatial: indexes of features; policy: see ``gate_opens``.
    """
    pickup = lambda g, cols: g[np.ix_([0, *[c + 1 for c in cols], g.shape[0] - 1], [0, *[c + 1 for c in cols], g.shape[0] - 1])]
    rows = []
    visible = [f for f in sorted(per_fold) if f != test_fold]
    for held in visible:
        fit = sum(per_fold[f] for f in visible if f != held)
        errors = []
        for cols in (shared, spatial):
            w, b = elastic_net(pickup(fit, cols), alpha)
            errors.append(squared_error(pickup(per_fold[held], cols), w, b))
        gain = (errors[0] - errors[1]) / max(errors[0], 1e-12)
        rows.append({"validation_fold": int(held), "global_mse": errors[0], "spatial_mse": errors[1], "relative_gain": gain, "improved": gain > 0})
    return gate_opens([r["relative_gain"] for r in rows], policy, min_folds, least_mean, worst), rows


def prediction_metrics(observed: Column, predicted: Column) -> list[Column]:
    """Aggregates n, mse, r2 and pearson over rows where both are finite; null with fewer than two."""
    good = observed.isNotNull() & predicted.isNotNull() & ~F.isnan(observed) & ~F.isnan(predicted)
    y, p = F.when(good, observed), F.when(good, predicted)
    n = F.count(y)
    many = n >= 2
    residual = F.sum((y - p) * (y - p))
    spread = F.stddev_pop(y) * F.stddev_pop(p)
    return [
        n.alias("n"), F.when(many, residual / n).alias("mse"), F.when(many, 1 - residual / (F.var_pop(y) * n + 1e-12)).alias("r2"),
        F.when(many, F.when(spread > 0, F.covar_pop(y, p) / spread).otherwise(0.0)).alias("pearson"),
    ]


def forward(parts: DataFrame, pixel: list[str], strength: float) -> tuple[DataFrame, DataFrame]:
    """Attribution of drivers at pixels, and predictions.

    parts: pixel columns, enh, activity, logit, fixed (coefficient of the global fit), learned (scale),
    background (before softplus), intercept. With strength 0 this is the global additive model.
    """
    spatial = F.col("learned") * (1 + F.tanh("logit"))
    attribution = F.col("fixed") + F.lit(strength) * (spatial - F.col("fixed"))
    active = F.greatest("activity", F.lit(0.0))
    maps = parts.withColumn("attribution", attribution).withColumn("contribution", active * F.col("attribution")).withColumn("global_part", active * F.col("fixed"))
    soft = F.greatest(F.col("background"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("background")))
    total = maps.groupBy(*pixel).agg(
        (F.sum("contribution") + F.first("intercept") + F.lit(strength) * F.first(soft)).alias("prediction"), (F.sum("global_part") + F.first("intercept")).alias("global_prediction")
    )
    return maps, total
