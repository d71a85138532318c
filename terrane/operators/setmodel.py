"""The attribution model's encoders in NumPy: convolution with GELU, and attention over a set of drivers.

Weights are drawn from a seed; they are inputs to the algebra in ``linear.forward``. The set step
treats drivers alike, so permuting them permutes its output, and padded drivers have no influence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def gelu(x: np.ndarray) -> np.ndarray:
    """The tanh form."""
    return 0.5 * x * (1 + np.tanh(0.7978845608028654 * (x + 0.044715 * x**3)))


def conv3x3(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """[n, c, h, w] with weights [o, c, 3, 3], zero padded."""
    p = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    out = np.zeros((x.shape[0], w.shape[0], *x.shape[2:]))
    for dy in range(3):
        for dx in range(3):
            out += np.einsum("nchw,oc->nohw", p[:, :, dy : dy + x.shape[2], dx : dx + x.shape[3]], w[:, :, dy, dx])
    return out


def weights(seed: int, width: int = 8) -> dict[str, np.ndarray]:
    """Scaled normal weights of all layers."""
    r = np.random.default_rng(seed)
    n = lambda *s: r.normal(size=s) / np.sqrt(np.prod(s[1:]))
    return {"c1": n(width, 1, 3, 3), "c2": n(width, width, 3, 3), "q": n(width, width), "k": n(width, width), "v": n(width, width), "o": n(width, width), "logit": n(1, width)[0], "scale": n(1, width)[0]}


def encode(maps: np.ndarray, w: dict[str, np.ndarray], real: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Local logits [n, h, w] and learned scales [n] of drivers' maps [n, h, w]; ``real`` marks drivers that aren't padding."""
    real = np.ones(len(maps), bool) if real is None else real
    feature = gelu(conv3x3(gelu(conv3x3(maps[:, None], w["c1"])), w["c2"]))
    token = feature.mean(axis=(2, 3))
    score = (token @ w["q"]) @ (token @ w["k"]).T / np.sqrt(token.shape[1])
    score[:, ~real] = -np.inf
    weight = np.exp(score - score.max(axis=1, keepdims=True))
    token = token + (weight / weight.sum(axis=1, keepdims=True)) @ (token @ w["v"]) @ w["o"]
    logits = np.einsum("nchw,c->nhw", feature + token[:, :, None, None], w["logit"])
    return logits * real[:, None, None], np.log1p(np.exp(token @ w["scale"])) * real


def encode_genes(pixels: DataFrame, seed: int = 1) -> DataFrame:
    """gene, enh, row, col, logit, learned from (gene, enh, row, col, activity): one gene's maps a group."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["enh", "row", "col"])
        names = rows["enh"].unique()
        h, w = rows["row"].max() + 1, rows["col"].max() + 1
        maps = np.zeros((len(names), h, w))
        place = {e: i for i, e in enumerate(names)}
        at = rows["enh"].map(place).to_numpy()
        maps[at, rows["row"], rows["col"]] = rows["activity"]
        logits, scale = encode(maps, weights(seed))
        return rows.assign(logit=logits[at, rows["row"], rows["col"]], learned=scale[at])[["gene", "enh", "row", "col", "logit", "learned"]]

    return pixels.groupBy("gene").applyInPandas(one, "gene int, enh int, row int, col int, logit double, learned double")
