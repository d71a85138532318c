import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from terrane.llm import resampling as R

from tests.differential import connect, duck_rows, spark_rows

from .conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(x.encode()) % R.BUCKETS for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(docs, items, percent=R.PERCENT):
    s, t = (Counter(b for x in texts for b in features(x)[1]) for texts in ([t for _, t in docs], items))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + R.BUCKETS) / ((s[b] + 1.0) * (all_t + R.BUCKETS))))
    rows = []
    for i, text in docs:
        n, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= R.MIN_WORDS), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return Counter((r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in rows)


def got(frame):
    return Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in frame.collect())


def test_brute_force(spark):
    r = random.Random(5)
    docs = [(i, prose(r, r.randint(0, 60)).upper() + "-É x9,") for i in range(300)]
    items = [docs[3][1], docs[8][1].lower(), prose(r, 200), None]
    found = got(R.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(x,) for x in items], "text string")))
    assert found == brute(docs, items) and sum(x[4] is not None for x in found) > 40


def test_nasty_rows(spark, nasty):
    docs = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    items = spark.createDataFrame([(docs[0][1],), (None,), ("",)], "text string")
    assert got(R.resample(nasty, items, percent=50)) == brute(docs, [docs[0][1]], 50)
    carried = R.resample(nasty, items, carry=["source", "key"], percent=50)
    assert carried.columns == ["doc_id", "source", "key", "n_features", "weight", "score", "rank"] and carried.count() == len(docs)
    with pytest.raises(ValueError):
        R.resample(nasty, items, carry=["score"])


def test_ties_and_repeats(spark):
    """A thousand equal rows, and rows of no id, are numbered each, without a gap."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(4, text)] * 1000 + [(None, text)] * 300 + [(None, text + " more")] * 3
    found = R.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(text,)], "text string"))
    assert got(found) == brute(docs, [text])
    ranks = sorted(r["rank"] for r in found.collect() if r["rank"])
    assert ranks == list(range(1, len(docs) * 25 // 100 + 1))


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b " * 10)] * 4, SCHEMA)
    assert R.resample(none, one).count() == 0
    assert got(R.resample(one, none)) == brute([(1, "a b " * 10)] * 4, [])
    assert {x["rank"] for x in R.resample(one.limit(3), none).collect()} == {None}


def test_offsets_are_those_of_the_sorted_scores(spark):
    r = random.Random(1)
    scores = [r.randint(-3000, 3000) for _ in range(4000)]
    found = {x.score: (x.n, x.above) for x in R.rank_offsets(spark.createDataFrame([(s,) for s in scores], "score long")).collect()}
    assert found == {s: (scores.count(s), sum(x > s for x in scores)) for s in set(scores)}


def test_draws_what_looks_like_the_target(spark):
    r = random.Random(2)
    near, far = prose(r, 80).split(), prose(r, 80).split()
    docs = [(i, " ".join(r.choices(near if i % 2 else far, k=50))) for i in range(400)]
    target = spark.createDataFrame([(" ".join(r.choices(near, k=3000)),)], "text string")
    drawn = [x.doc_id for x in R.resample(spark.createDataFrame(docs, SCHEMA), target).where("rank is not null").collect()]
    assert len(drawn) == 100 and sum(i % 2 for i in drawn) > 80  # 50 by chance; noise is drawn, too


def test_sql(spark):
    from terrane.llm.oracles import ORACLES
    from terrane.llm.queries import QUERIES

    small = "/root/testdata/sf0.001"
    assert spark_rows(QUERIES["op12_importance_resampling"](spark, small)) == duck_rows(connect(small), ORACLES["op12_importance_resampling"])
