import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from terrane.llm import toxicity as T

from .conftest import prose


def test_pairs_are_learned():
    """An insult alone or a group's mention alone is label 0, both together are label 1."""
    r = random.Random(4)
    texts, labels = [], []
    for _ in range(1500):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(prose(r, 20) + (" insultword" if a else "") + " " + prose(r, 9) + (" groupname" if b else ""))
        labels.append(int(a and b))
    m = T.fit([np.array(sorted({T.bucket(t) for t in T.terms(x)})) for x in texts], np.array(labels))
    import pandas as pd

    s = m.score(pd.Series(["insultword", "groupname", "insultword groupname", "", None]))
    assert s[2] > 0.5 and (s[[0, 1, 3, 4]] < 0.5).all()


def test_what_no_sum_of_weights_can_tell():
    """ab and cd are label 1, ac and bd label 0: weights would have to add up to more and to less for the same four terms."""
    import pandas as pd

    r, texts, labels = random.Random(7), [], []
    for _ in range(3000):
        kind = r.choice(("ab", "cd", "ac", "bd", "", ""))
        texts.append(" ".join([prose(r, 6), *[x + "word" for x in kind], prose(r, 6)]))
        labels.append(int(kind in ("ab", "cd")))
    m = T.fit([np.array(sorted({T.bucket(t) for t in T.terms(x)})) for x in texts], np.array(labels))
    s = m.score(pd.Series(["aword bword", "cword dword", "aword cword", "bword dword", "x"]))
    assert (s[:2] > 0.5).all() and (s[2:] < 0.5).all()


def test_margin_is_that_of_the_scores():
    rng = np.random.default_rng(0)
    m = T.Model(np.arange(3), 0.5, rng.normal(size=3), rng.normal(size=(3, 4)))
    x = np.array([[1, 0, 1]], float)
    pair = m.factors[0] @ m.factors[2]
    assert np.isclose(m.margin(x)[0], 0.5 + m.weights[0] + m.weights[2] + pair)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = T.score_toxicity(docs, labels).join(labels, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert not [r for r in got if r.predicted and not r.toxic]
    assert sum(r.predicted for r in got if r.toxic) >= 0.6 * sum(r.toxic for r in got)


def test_rows_that_were_never_trained_on(spark):
    """Held-out rows alone, of the largest given table: what is toxic is found, and clean rows are left alone."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = T.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if r.toxic == 0]
    assert len(toxic) > 20 and sum(r.predicted for r in toxic) >= 0.8 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_labels_lang_source_and_held_out_rows_dont_matter(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    base = {r.doc_id: r.score for r in T.score_toxicity(docs, labels).collect()}
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in T.score_toxicity(docs.withColumn("lang", F.lit("x")), flipped).collect()}
    assert base == again


def test_edges(spark, nasty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert T.score_toxicity(nasty, labels).count() == nasty.count()
    assert {r.score for r in T.score_toxicity(nasty, labels.limit(0)).collect()} == {0.5}
    assert T.score_toxicity(nasty.limit(0), labels).count() == 0
    assert T.keep_clean(nasty, labels).columns == nasty.columns
