import collections

from terrane.llm import quality as Q

from .conftest import nasty_rows


def brute(text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_measures_match_brute_force(spark, nasty):
    rows = nasty_rows() + [(20, "a b c d e f a b c d e f g a b c d e", "s"), (21, "é# é# | x\né# é# | x\n\n\n", "s"), (22, "q " * 9, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Q.host_quality(docs).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(tuple(r[f] for f in fields) for r in got) == sorted(brute(t) for _, t, _ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_strict_hosts_drop_soft_failures_only(spark):
    clean = " ".join(f"word{i}" for i in range(30))
    soft = " ".join(f"w### {i}" for i in range(30))
    rows = [(i, soft, "bad") for i in range(60)] + [(100, clean, "bad"), (101, clean, "good"), (102, soft, "good")] + [(200 + i, clean, "good") for i in range(60)]
    got = {r.doc_id: r for r in Q.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].strict and not got[0].kept and got[100].kept
    assert got[102].soft_failed and got[102].kept and got[101].kept and not got[101].strict


def test_edges(spark, nasty):
    assert Q.host_quality(nasty).count() == nasty.count()
    assert Q.host_quality(nasty.limit(0)).count() == 0
    one = Q.host_quality(nasty.where("doc_id = 3")).first()
    assert one.kept and one.host == "s2"
