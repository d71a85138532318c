import random
import re

from pyspark.sql import functions as F
from terrane.llm import decontaminate as D

from .conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            q = words(t)
            n = min(13, len(q))
            windows = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), tuple(sorted(found))))
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = D.find_contamination(d, b, out="c", **kw).select("doc_id", "c.*").collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in rows), key=str)


def cases():
    r = random.Random(1)
    items = [(i, prose(r, r.choice((30, 13, 14, 12, 5, 3, 60)))) for i in range(20)] + [(100, None), (101, ""), (102, "..."), (3, "One Two, three")]
    items += [(103, "la la la la la la la la la la la la la la la la"), (104, "Ab cd ab cd ab cd ab cd ab cd ab cd ab cd ab")]
    docs = []
    for i in range(60):
        parts = [prose(r, r.randint(0, 60)) for _ in range(3)]
        t = (r.choice(items[:20])[1] or "").split(" ")
        k = r.randint(0, len(t))
        parts.insert(1, " ".join(t[k : k + r.randint(1, 40)]).upper() if i % 3 else " ,".join(t))
        docs.append((i, " ".join(parts)))
    docs += [(60, "la " * 40), (61, "zz " + "ab cd " * 30), (62, None), (63, ""), (None, items[0][1]), (64, items[1][1]), (64, "nothing"), (65, "one TWO three four")]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = cases()
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, broadcast_rows=0) == want
    assert sum(w[2] > 0 for w in want) > 20


def test_every_window_of_thirteen_is_found(spark):
    r = random.Random(5)
    items = [(i, prose(r, 40)) for i in range(30)]
    docs = [(100 * i + k, " ".join([prose(r, 7), *t.split(" ")[k : k + 13], prose(r, 9)])) for i, t in items for k in range(0, 28, 3)]
    assert all(n_hit >= 13 for _, _, n_hit, _, _ in run(spark, docs, items))


def test_edges(spark, nasty):
    bench = spark.createDataFrame([(1, "one two"), (None, "x x x")], "item_id long, text string")
    got = {(r.doc_id, r.n_hit): r for r in D.find_contamination(nasty, bench, out="n_words").select("doc_id", "n_words.*").collect()}
    assert (7, 2) in got and got[10, 5000].n_items == 1 and got[10, 5000]["items"] == []
    assert D.find_contamination(nasty, bench, out="N_WORDS").count() == nasty.count()
    assert D.find_contamination(nasty.limit(0), bench).count() == 0
    none = D.find_contamination(nasty, bench.limit(0), out="c").agg(F.sum("c.n_hit")).first()[0]
    assert none == 0


def test_repetitive_texts_take_proportional_time_and_spans_are_joined(spark):
    import time

    items = [(1, "zz " * 40), (2, "zz " * 14 + "q")]
    began = time.time()
    docs = spark.createDataFrame([(1, "zz " * 50_000), (2, "a " + "zz " * 20 + "b " + "zz " * 15 + "q c")], "doc_id long, text string")
    got = {r.doc_id: r.c for r in D.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), out="c").collect()}
    assert time.time() - began < 30
    assert [tuple(s) for s in got[1].spans] == [(0, 50_000)] and got[1].n_hit == 50_000 and got[1]["items"] == ["1", "2"]
    assert [tuple(s) for s in got[2].spans] == [(1, 21), (22, 38)] and got[2].n_hit == 36
