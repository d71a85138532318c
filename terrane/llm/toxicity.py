"""Toxicity by a factorization machine over hashed terms.

The score of a text is logistic(b + sum w_i + sum over pairs <v_i, v_j>) over the terms it contains, so
that a pair such as an insult with the mention of a group weighs more (or less) than its parts. Terms
are the words, and for each word beginning how many different words share it (languages that inflect
an insult rarely repeat a form). They are hashed; of the buckets, those whose presence tells the classes apart in the training rows are
features, and all others are left out, so a long text's ordinary words add nothing. The model is
fitted in the driver on a bounded sample of labelled rows; scoring is one pass over whole texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import small_batches

#: Labelled rows that the model is fitted to, at most: those of the least id hashes.
MAX_LABELLED = 8_000
BUCKETS, FEATURES, FACTORS = 1 << 20, 768, 4
MIN_ROWS, MIN_Z = 5, 4.0
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 512, 0.05, 1e-4, 11
FOLDS = 5
_BREAKS = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b < 0x80 else b for b in range(256))


#: Lengths of word beginnings, in characters, and the numbers of different words that are terms.
BEGINNINGS, SHARED = (4, 5, 6, 7), (2, 3, 4)


def words(text: str | None) -> set[bytes]:
    """Distinct lower-case words of the whole text."""
    return set((text or "").encode("utf-8", "replace").translate(_BREAKS).split())


def beginnings(word: bytes) -> list[bytes]:
    """Marked beginnings of a word that are shorter than it."""
    letters = word.decode("utf-8", "replace")
    return [b"^" + letters[:n].encode() for n in BEGINNINGS if len(letters) > n]


def shared(beginning: bytes, n: int) -> bytes:
    """The term that says that at least n different words begin so."""
    return b"%s:%d" % (beginning, n)


def terms(text: str | None) -> set[bytes]:
    """Terms of the whole text."""
    found = words(text)
    many = Counter(b for w in found for b in beginnings(w))
    return found | {shared(b, n) for b, c in many.items() for n in SHARED if c >= n}


def bucket(term: bytes) -> int:
    """The bucket that a term is hashed to."""
    return zlib.crc32(term) % BUCKETS


@dataclass(frozen=True)
class Model:
    """buckets: sorted buckets that are features; bias, weights and factors (features x FACTORS)."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Of a dense 0/1 matrix, rows by features."""
        s = rows @ self.factors
        return self.bias + rows @ self.weights + 0.5 * ((s * s).sum(1) - rows @ (self.factors**2).sum(1))

    def score(self, texts: pd.Series) -> np.ndarray:
        """Probability of label 1 for each text."""
        place = {int(b): i for i, b in enumerate(self.buckets)}
        #: word -> its feature, and those of its beginnings that are part of a feature
        known: dict[bytes, tuple[int, list[bytes]]] = {}
        steps: dict[bytes, list[tuple[int, int]]] = {}
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            if len(known) > 500_000:
                known.clear(), steps.clear()
            at, many = set(), Counter()
            for w in words(text):
                hit = known.get(w)
                if hit is None:
                    live = []
                    for b in beginnings(w):
                        if b not in steps:
                            steps[b] = [(n, i) for n in SHARED if (i := place.get(bucket(shared(b, n)))) is not None]
                        if steps[b]:
                            live.append(b)
                    hit = known[w] = (place.get(bucket(w), -1), live)
                if hit[0] >= 0:
                    at.add(hit[0])
                if hit[1]:
                    many.update(hit[1])
            at.update(i for b, c in many.items() for n, i in steps[b] if c >= n)
            at = sorted(at)
            v = self.factors[at]
            s = v.sum(0)
            out[k] = self.bias + self.weights[at].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(found: list[np.ndarray], labels: np.ndarray) -> Model:
    """Model from the buckets of each row and its 0/1 label; without both classes, the smoothed rate alone."""
    n, pos = len(labels), int(labels.sum())
    rate = (pos + 0.5) / (n + 1)
    bias = float(np.log(rate / (1 - rate)))
    nothing = Model(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < pos < n:
        return nothing
    sizes = np.array([len(x) for x in found])
    flat = np.concatenate(found) if sizes.sum() else np.zeros(0, np.int64)
    values, inverse = np.unique(flat, return_inverse=True)
    of_one = np.repeat(labels, sizes).astype(float)
    have = np.bincount(inverse, minlength=len(values))
    have_pos = np.bincount(inverse, of_one, minlength=len(values))
    p, q = (have_pos + rate) / (have + 1), pos / n
    z = np.abs(p - q) * np.sqrt((have + 1) / (q * (1 - q)))
    fine = np.flatnonzero((have >= min(MIN_ROWS, max(1, pos // 4))) & (z >= MIN_Z))
    fine = np.sort(fine[np.argsort(-z[fine], kind="stable")[:FEATURES]])
    if not len(fine):
        return nothing
    place = np.full(len(values), -1)
    place[fine] = np.arange(len(fine))
    x = np.zeros((n, len(fine)), np.float32)
    cols = place[inverse]
    x[np.repeat(np.arange(n), sizes)[cols >= 0], cols[cols >= 0]] = 1
    rng = np.random.default_rng(SEED)
    y = labels.astype(np.float32)
    params = [np.full(1, bias), np.zeros(len(fine)), rng.normal(0, 0.05, (len(fine), FACTORS))]
    m, v, step = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = x[order[at : at + BATCH]]
            s = rows @ params[2]
            margin = params[0][0] + rows @ params[1] + 0.5 * ((s * s).sum(1) - rows @ (params[2] ** 2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y[order[at : at + BATCH]]) / len(rows)
            per_feature = rows.T @ g
            grads = [np.array([g.sum()]), per_feature + DECAY * params[1], rows.T @ (g[:, None] * s) - per_feature[:, None] * params[2] + DECAY * params[2]]
            step += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                params[i] = params[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(values[fine], float(params[0][0]), params[1], params[2])


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, mod FOLDS, is 0 (a null id counts as '')."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Model from the labelled rows that aren't held out, at most ``max_labelled`` of them.

    Rows without an id or a label don't count; an id with several labels has the largest of them.
    """
    docs = small_batches(docs)
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null and y is not null")
    chosen = usable.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").limit(max_labelled)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.fromiter(map(bucket, t), np.int32, len(t))).tobytes() for t in map(terms, batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["_id", "x", "y"])

    # At most max_labelled ids: their size is bounded, so they may be broadcast.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select(F.col("_id").cast("string"), "_text", "y")
    rows = texts.mapInArrow(features, "_id string, x binary, y int").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["_id"], r["x"]))
    return fit([np.frombuffer(r["x"], np.int32).astype(np.int64) for r in rows], np.array([r["y"] for r in rows], np.int64))


def score_column(model: Model, text: Column) -> Column:
    """The model's score of a text column."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(batch))

    return scored(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    A null or empty text has the score of a text without known terms. Repeated rows are returned each;
    other columns are left out, so none can clash. Without labels all scores are 0.5. An empty table
    gives no rows.
    """
    model = train(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score_column(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, whole and unchanged."""
    model = train(docs, labels, id_col, text_col)
    return docs.where(score_column(model, F.col(text_col)) < 0.5)
