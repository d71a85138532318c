import random
from collections import defaultdict

import pytest
from jobs import word_screen as W

from tests.differential import connect, duck_rows, spark_rows

from .test_observation_stream import pearson

SMALL = "/root/testdata/sf0.001"


def tables(spark, at, n=300):
    r = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        lang, toxic, good = "abc"[i % 3], int(r.random() < 0.4), int(r.random() < 0.5)
        words = ["all", "Bad" if toxic and r.random() < 0.8 else "fine", "LOCAL" if toxic and lang == "b" and r.random() < 0.9 else "x", f"rare{i}", *r.choices(["u", "v", "w"], k=2)]
        docs.append((i, " ".join(words) + ",", lang if i % 50 else None))
        labels.append((i, good, toxic if i % 20 else None))
    docs += [(5000, "bad bad", "a"), (5001, None, "a")]
    labels += [(5001, 1, 1), (7000, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return docs, labels


def brute(docs, labels, least):
    """(target, word) -> (documents, global, best local, its domain)."""
    texts, out = {i: (set((t or "").lower().replace(",", " ").split()), g or "none") for i, t, g in docs}, {}
    for k, target in enumerate(("quality", "toxic")):
        known = [(texts[x[0]], x[1 + k]) for x in labels if x[0] in texts and x[1 + k] is not None]
        for w in {w for (words, _), _ in known for w in words}:
            by = defaultdict(list)
            for (words, lang), y in known:
                by[lang].append((float(w in words), float(y)))
            n = sum(w in words for (words, _), _ in known)
            if n >= least:
                best, at = min((-pearson(*zip(*p)), g) for g, p in by.items())
                out[target, w] = (n, pearson(*zip(*[x for p in by.values() for x in p])), -best, at)
    return out


def written(spark, at):
    return {(r.target, r.word): r for r in W.words_of(spark, f"{at}/out").collect()}


def test_agrees_with_brute_force_and_reruns(spark, tmp_path):
    docs, labels = tables(spark, tmp_path)
    c = W.Config(f"{tmp_path}/documents.parquet", f"{tmp_path}/labels.parquet", f"{tmp_path}/out", min_documents=10)
    done = W.run(spark, c)
    found, wanted = written(spark, tmp_path), brute(docs, labels, 10)
    assert found.keys() == wanted.keys() and done == {"read": sum(v is not None for x in labels[:-1] for v in x[1:]), "words": len(wanted), "targets": 2}
    for k, v in wanted.items():
        r = found[k]
        assert (r.n_documents, r.global_concordance, r.max_regional_concordance) == pytest.approx(v[:3], abs=3e-6) and r.best_domain == v[3], k
    assert found["toxic", "bad"].predicted_class == "core_concordant" and found["toxic", "local"].best_domain == "b" and found["toxic", "local"].predicted_class != "unsupported"
    assert found["toxic", "all"].predicted_class == "unsupported"
    scores = {r.target: r.asDict() for r in spark.read.parquet(f"{tmp_path}/out/targets").collect()}
    assert {t: s["n_words"] for t, s in scores.items()} == {t: sum(x == t for x, _ in wanted) for t in ("quality", "toxic")}
    assert W.run(spark, c) == done and written(spark, tmp_path) == found
    one = W.run(spark, W.Config(c.documents, c.labels, c.out, targets=("toxic",), min_documents=10))
    assert one["targets"] == 1 and written(spark, tmp_path) == found
    assert {r.target: r.asDict() for r in spark.read.parquet(f"{tmp_path}/out/targets").collect()} == scores


def test_no_labels(spark, tmp_path):
    tables(spark, tmp_path, 30)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none.parquet")
    assert W.run(spark, W.Config(f"{tmp_path}/documents.parquet", f"{tmp_path}/none.parquet", f"{tmp_path}/out")) == {"read": 0, "words": 0, "targets": 0}
    assert W.words_of(spark, f"{tmp_path}/out").collect() == []


def test_query_agrees_with_sql(spark):
    from jobs.queries import ORACLES, QUERIES

    rows = spark_rows(QUERIES["job2_word_screen"](spark, SMALL))
    assert rows == duck_rows(connect(SMALL), ORACLES["job2_word_screen"]) and rows[1]
