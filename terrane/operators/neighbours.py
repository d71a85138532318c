"""Joins by closeness: binned ranges, nearest neighbours in cells of a k-d tree, in a box or a periodic one.

No join here is a cross join of tables: candidates meet by an equi join on cells. Searches look at a
point's own cell, and then at all cells that the ball of the distance found there meets. Searches within
many groups (``nearest``) set the groups apart along one more axis.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.numeric import pick
from terrane.operators.cells import PER_CELL as PER_CELL_TREE
from terrane.operators.cells import SAMPLE, Cells, fit, gather
from terrane.operators.lineage import cut


def range_join(left: DataFrame, right: DataFrame, on: list[str], at: str, to: str, reach: int) -> DataFrame:
    """Pairs with equal ``on`` and abs(left.at - right.to) <= reach: bins of the reach's width, three of them a row."""
    binned = right.withColumn("_bin", F.floor(F.col(to) / reach))
    asked = left.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(at) / reach) + k for k in (-1, 0, 1)])))
    return asked.join(binned, [*on, "_bin"]).where(F.abs(F.col(at) - F.col(to)) <= reach).drop("_bin")


def range_anti_join(left: DataFrame, right: DataFrame, on: list[str], at: str, to: str, reach: int) -> DataFrame:
    """Rows of left with no row of right within reach: the same bins, as an anti join."""
    spread = right.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(to).alias("_to"), F.explode(F.array(*[F.floor(F.col(to) / reach) + k for k in (-1, 0, 1)])).alias("_b"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in on])
    return left.withColumn("_bin", F.floor(F.col(at) / reach)).join(spread, same & (F.col("_bin") == F.col("_b")) & (F.abs(F.col(at) - F.col("_to")) <= reach), "left_anti").drop("_bin")


def _apart(points: DataFrame, axes: list[str], by: list[str], node: str) -> tuple[DataFrame, float]:
    """by, id, axes and _group (stored), and how far groups are apart on that axis: further than any two points of one.

    Points without coordinates are left out.
    """
    base = points.select(*by, F.col(node).alias("id"), *[F.col(c).cast("double").alias(c) for c in axes])
    base = cut(base.where(" and ".join(f"{c} is not null and not isnan({c})" for c in axes)))
    span = base.agg(*[(F.max(c) - F.min(c)).alias(c) for c in axes]).first()
    gap = 1.0 + 2 * sum((span[c] or 0.0) ** 2 for c in axes) ** 0.5
    if not by:
        return cut(base.withColumn("_group", F.lit(0.0))), gap
    named = [F.col(c).alias(f"_{c}") for c in by]
    groups = cut(base.select(*named).distinct().withColumn("_group", F.row_number().over(Window.orderBy(*[f"_{c}" for c in by])) * gap))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return cut(base.join(groups, same).select(*by, "id", *axes, "_group")), gap


def nearest(points: DataFrame, k: int, axes: list[str], by: list[str] | None = None, node: str = "obs_id", answers: str = "true") -> DataFrame:
    """by, src, dst, rank, d2: the k nearest other points of each point of its group; ties by id. Distances are rounded to 9 digits.

    Groups are set apart along one more axis, so that one ``search`` answers all of them, however large or small.
    Points without coordinates are left out. Points of one position ask once, for one more than k. Only points for
    which ``answers`` (SQL over id) holds are neighbours of others.
    """
    by = by or []
    base, gap = _apart(points, axes, by, node)
    at = [*axes, "_group"]
    found = search(base.select(*at).distinct(), base.where(F.expr(answers)), at, at, k + 1)
    others = F.slice(F.filter("found", lambda x: (x["id"] != F.col("src")) & (x["d2"] < gap * gap)), 1, k)
    listed = base.withColumnRenamed("id", "src").join(found, at).select(*by, "src", F.posexplode(others).alias("rank", "x"))
    return listed.select(*by, "src", F.col("x.id").alias("dst"), (F.col("rank") + 1).alias("rank"), F.col("x.d2").alias("d2"))


def blocks(points: DataFrame, axes: list[str], by: list[str], node: str = "obs_id", size: int = 1024) -> DataFrame:
    """by, id, block: the points of each group in blocks of about ``size`` that lie together."""
    base, _ = _apart(points, axes, by, node)
    at = [*axes, "_group"]
    cells = build_cells(base, at, 1, size)
    return _with_cell(base, at, cells.home).select(*by, "id", F.col("cell").alias("block"))


def _thin(points: DataFrame, axes: list[str], k: int) -> DataFrame:
    """id and axes; of the points of one position, those of the k smallest ids, which are all that a search for k can return."""
    return points.withColumn("_place", pick([F.col("id")], axes)).where(F.col("_place") <= k).select("id", *axes)


def build_cells(points: DataFrame, axes: list[str], least: int, per_cell: int = PER_CELL_TREE) -> Cells:
    """Cells of at least ``least`` points; the driver sees a sample and one row a cell."""
    n = points.count()
    sample = points.select(*axes).sample(min(1.0, SAMPLE / max(n, 1)), 7).toPandas().to_numpy(float) if n > per_cell else np.zeros((0, len(axes)))
    splits = fit(sample, n, per_cell)
    held = _with_cell(points, axes, splits.leaf).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in axes]).toPandas()
    bound = lambda name: held[[f"{name}_{c}" for c in axes]].to_numpy(float).reshape(-1, len(axes))
    return gather(splits, held["cell"].to_numpy(np.int64), held["n"].to_numpy(np.int64), bound("min"), bound("max"), least)


def _with_cell(points: DataFrame, axes: list[str], cell_of) -> DataFrame:
    """``points`` with the number that ``cell_of`` gives to their position."""

    def number(frames):
        for frame in frames:
            yield frame.assign(cell=cell_of(frame[axes].to_numpy(float)))

    return points.mapInPandas(number, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", cell long")


def _dealt(asked: DataFrame) -> DataFrame:
    """Questions of a cell side by side, a cell with many over several partitions."""
    return asked.hint("rebalance", "cell").sortWithinPartitions("cell")


def _least(q: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int, most: np.ndarray, periodic: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, d2, place in ``ids``), ordered so, of each question's k least (d2, id) with d2 up to ``most``."""
    found = []
    for lo in range(0, len(q), 512):
        d2 = np.zeros((len(q[lo : lo + 512]), len(at)))
        for a in range(at.shape[1]):
            gap = np.abs(q[lo : lo + 512, a, None] - at[None, :, a])
            d2 += np.minimum(gap, 1 - gap) ** 2 if periodic else gap**2
        d2 = np.round(d2, 9)
        worst = most[lo : lo + 512]
        if len(at) > k:
            worst = np.minimum(worst, np.partition(d2, k - 1, axis=1)[:, k - 1])
        who, which = np.nonzero(d2 <= worst[:, None])
        order = np.lexsort((ids[which], d2[who, which], who))
        who, which = who[order], which[order]
        first = np.searchsorted(who, who)
        keep = np.arange(len(who)) - first < k
        found.append((who[keep] + lo, d2[who[keep], which[keep]], which[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(asked: DataFrame, points: DataFrame, keys: list[str], axes: list[str], k: int, periodic: bool = False, per_cell: int = PER_CELL_TREE, with_place: bool = False) -> DataFrame:
    """keys and found: the k least (d2, id) of ``points`` (id, axes) for each question (keys, axes), as a sorted array.

    ``with_place``: found points have their axes, too.

    ``periodic``: in the unit box, whose sides meet. Squared distances are rounded to 9 digits, ties go to the smaller
    id. Fewer than k points give fewer. A question is answered in its own cell first; the k-th distance there bounds
    the ball whose other cells are then visited, so two rounds are exact. Cells are bounded in size and questions come to
    them in batches, so neither clusters nor many equal points or questions gather in one task.
    """
    points = cut(_thin(points, axes, k))
    cells = build_cells(points, axes, k, per_cell)
    packs = _with_cell(points, axes, cells.home).groupBy("cell").agg(F.collect_list(F.struct("id", *axes)).alias("pack"))
    packs = cut(packs.select("cell", "pack.id", *[F.col(f"pack.{c}").alias(f"p_{c}") for c in axes]))
    names = list(dict.fromkeys([*keys, *axes]))
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    whole = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    d, parts = len(axes), ["d2", "id", *(axes if with_place else [])]
    images = np.stack(np.meshgrid(*[(-1, 0, 1) if periodic else (0,)] * d, indexing="ij"), axis=-1).reshape(-1, d)

    def batches(frames, more):
        """Questions of one batch and cell as one row of arrays."""
        for frame in frames:
            grouped = frame.groupby("cell", sort=False)
            yield pd.DataFrame([(cell, *[part[c].to_numpy() for c in [*names, *more]]) for cell, part in grouped], columns=["cell", *names, *more])

    def packed(frame, more, kinds_of_more):
        schema = "cell long, " + ", ".join(f"`{c}` array<{t}>" for c, t in [*((c, kinds[c]) for c in names), *zip(more, kinds_of_more, strict=True)])
        return _dealt(frame).mapInPandas(lambda frames: batches(frames, more), schema).join(packs, "cell")

    def answer(frames, first):
        for frame in frames:
            for row in frame.to_dict("records"):
                q = np.stack([np.asarray(row[c], float) for c in axes], axis=1)
                at = np.stack([np.asarray(row[f"p_{c}"], float) for c in axes], axis=1)
                most = np.full(len(q), np.inf) if first else np.asarray(row["most"], float)
                ids = np.asarray(row["id"])
                who, d2, which = _least(q, at, ids, k, most, periodic)
                values = [d2.tolist(), ids[which].tolist(), *(at[which].T.tolist() if with_place else [])]
                listing = [dict(zip(parts, x, strict=True)) for x in zip(*values, strict=True)]
                ends = np.searchsorted(who, np.arange(len(q) + 1))
                out = pd.DataFrame({c: row[c] for c in names})
                out["found"] = [listing[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
                if first:
                    full = ends[1:] - ends[:-1] == k
                    out["most"] = np.where(full, d2[np.maximum(ends[1:] - 1, 0)], np.inf) if len(d2) else np.inf
                    reach = (np.sqrt(out["most"].to_numpy()) + 1e-6) ** 2
                    places, there = zip(*[cells.near(q + image, reach) for image in images], strict=True)
                    pairs = np.unique(np.stack([np.concatenate(places), np.concatenate(there)], axis=1), axis=0)
                    pairs = pairs[pairs[:, 1] != row["cell"]]
                    stops = np.searchsorted(pairs[:, 0], np.arange(len(q) + 1))
                    out["visits"] = [pairs[s:e, 1].tolist() for s, e in zip(stops[:-1], stops[1:], strict=True)]
                yield out

    listed = f"{whole}, found array<struct<d2: double, id: {dict(points.dtypes)['id']}{''.join(f', {c}: double' for c in parts[2:])}>>"
    home = packed(_with_cell(asked.select(*names), axes, cells.home), [], [])
    near = cut(home.mapInPandas(lambda frames: answer(frames, True), f"{listed}, most double, visits array<long>"))
    visits = near.where("size(visits) > 0").select(*names, "most", F.explode("visits").alias("cell"))
    seen = packed(visits, ["most"], ["double"]).mapInPandas(lambda frames: answer(frames, False), listed).where("size(found) > 0")
    both = near.where("size(visits) > 0").select(*keys, "found").unionByName(seen.select(*keys, "found"))
    merged = both.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    return near.where("size(visits) = 0").select(*keys, "found").unionByName(merged)


def nearest_points(points: DataFrame, k: int, axes: list[str], node: str = "obs_id", answers: str = "true") -> DataFrame:
    """src, dst, rank, d2: the k nearest other points of each point; see ``search``.

    Points without coordinates are left out. Only points for which ``answers`` (SQL over id) holds are neighbours
    of others. Points of one position ask once, for one more than k, and each leaves itself out.
    """
    base = points.select(F.col(node).alias("id"), *[F.col(c).cast("double").alias(c) for c in axes])
    base = cut(base.where(" and ".join(f"{c} is not null and not isnan({c})" for c in axes)))
    found = search(base.select(*axes).distinct(), base.where(F.expr(answers)), axes, axes, k + 1)
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("src")), 1, k)
    listed = base.withColumnRenamed("id", "src").join(found, axes).select("src", F.posexplode(others).alias("rank", "x"))
    return listed.select("src", F.col("x.id").alias("dst"), (F.col("rank") + 1).alias("rank"), F.col("x.d2").alias("d2"))


def periodic_nearest(asked: DataFrame, points: DataFrame, node: str, axes: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys (``node`` alone by default) and nearest: the nearest point in the unit box whose sides meet, by ``search``."""
    keys = keys or [node]
    found = search(asked, points.select(F.col(node).alias("id"), *axes), keys, axes, 1, periodic=True)
    return found.select(*keys, F.expr("found[0].id").alias("nearest"))
