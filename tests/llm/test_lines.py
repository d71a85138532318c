import random

from terrane.llm import lines as L
from terrane.operators.lineage import store

from .conftest import nasty_rows, prose


def shingles(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} if len(line) >= 5 else {line}


def content(line):
    return line.strip(" \t\r\x0b\x0c")


def brute(rows):
    """Kept text of each row, all pairs of lines compared; ids are unique."""
    nodes = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if content(x):
                nodes[content(x)] = min(nodes.get(content(x), i), i)
    names = sorted(nodes)
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {x: shingles(x) for x in names}
    for a in range(len(names)):
        for b in range(a):
            x, y = sets[names[a]], sets[names[b]]
            if len(x & y) >= 0.8 * len(x | y):
                parent[find(names[a])] = find(names[b])
    groups = {}
    for x in names:
        groups.setdefault(find(x), []).append(x)
    keeper = {}
    for members in groups.values():
        low = min(nodes[m] for m in members)
        for m in members:
            keeper[m] = (low, len([x for x in members if nodes[x] == low]) == 1 and nodes[m] == low)
    return keeper


def corpus(seed, n):
    r = random.Random(seed)
    rows, pool = [], []
    for i in range(n):
        out = []
        for _ in range(r.randint(1, 6)):
            how = r.random()
            if how < 0.5 or not pool:
                out.append(prose(r, r.randint(1, 60)))
                pool.append(out[-1])
            elif how < 0.7:
                out.append(r.choice(pool))
            elif how < 0.9:
                w = r.choice(pool).split(" ")
                w[r.randrange(len(w))] += "q"
                out.append("  " + " ".join(w))
            else:
                out.append("")
        rows.append((i, "\n".join(out)))
    return rows


def test_recall_and_precision_against_all_pairs(spark):
    rows = corpus(1, 250)
    keeper = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.d for r in L.dedup_lines(docs, out="d").collect()}
    wanted = missed = wrong = 0
    for i, t in rows:
        left = [content(x) for x in got[i].text.split("\n")]
        for x in {content(x) for x in t.split("\n")} - {""}:
            low, sure = keeper[x]
            if low != i:
                wanted += 1
                missed += x in left
            elif sure:
                wrong += x not in left
    assert wanted > 200 and missed <= 0.03 * wanted and wrong <= missed


def test_both_ways_of_joining_agree(spark):
    docs = spark.createDataFrame(corpus(2, 60), "doc_id long, text string")
    a, b = (sorted((r.doc_id, r.d.text) for r in L.dedup_lines(docs, out="d", rows=n).collect()) for n in (L.BROADCAST_ROWS, 0))
    assert a == b


def test_verified_links_are_similar(spark):
    rows = corpus(3, 80)
    docs = spark.createDataFrame(rows, "id long, text string")
    from pyspark.sql import functions as F

    links = L.near_equal(docs, store(L._signed(docs)))
    texts = {content(x) for _, t in rows for x in t.split("\n")}
    named = {r.h: r.x for r in spark.createDataFrame([(x,) for x in texts], "x string").select("x", F.xxhash64("x").alias("h")).collect()}
    for r in links.collect():
        a, b = shingles(named[r.u]), shingles(named[r.v])
        assert len(a & b) >= 0.8 * len(a | b)


def test_edges(spark, nasty):
    rows = nasty_rows()
    got = L.dedup_lines(nasty, out="d").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.d for r in got}
    assert by[1].n_removed == 0 and by[2].text == "" and by[2].n_removed == by[2].n_lines == 1
    assert by[4].text is None and by[4].n_lines == 0 and by[6].text == " \n\t " and by[5].text == ""
    assert by[11].text == "" and by[11].n_removed == 3
    assert by[8].n_lines == 60
    assert L.dedup_lines(nasty.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a b\na b\n\nc\n"), (None, "c\nd"), (None, "d")], "doc_id long, text string")
    assert sorted(r.d.text for r in L.dedup_lines(same, out="d").collect()) == ["a b\n\nc\n", "d", "d"]


def varied(r, text):
    """``text`` after an edit: a character or a word replaced, put in or left out."""
    w = text.split(" ")
    i = r.randrange(len(w))
    how = r.randrange(4)
    if how == 0:
        w[i] = prose(r, 1)
    elif how == 1:
        w.insert(i, prose(r, 1))
    elif how == 2 and len(w) > 1:
        del w[i]
    else:
        k = r.randrange(len(w[i]) + 1)
        w[i] = w[i][:k] + "q" + w[i][k + r.randrange(2) :]
    return " ".join(w)


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def similar_pairs(r, low, high, n, joint=" "):
    """n pairs of lines of low to high words, edited until their similarity is 0.8 to 0.88."""
    pairs = []
    while len(pairs) < n:
        a = b = prose(r, r.randint(low, high))
        while similarity(a.replace(" ", joint), b.replace(" ", joint)) > 0.88:
            b = varied(r, b)
        a, b = a.replace(" ", joint), b.replace(" ", joint)
        if similarity(a, b) >= 0.8:
            pairs.append((a, b))
    return pairs


def test_bands_find_pairs_of_all_lengths_and_edits(spark):
    """Of pairs of similarity 0.8 to 0.88, by number of words; prose without blanks has its own class (negative)."""
    r = random.Random(11)
    classes = ((1, 3), (4, 6), (7, 15), (16, 60), (100, 200))
    pairs = [(low, *p) for low, high in classes for p in similar_pairs(r, low, high, 400)]
    pairs += [(-low, *p) for low, high in classes[1:] for p in similar_pairs(r, low, high, 200, joint="")]
    rows = [(2 * i + k, x) for i, (_, *both) in enumerate(pairs) for k, x in enumerate(both)]
    keys = {q.id: set(q["keys"] or ()) for q in L._signed(spark.createDataFrame(rows, "id long, text string")).collect()}
    shared = {low: [bool(keys[2 * i] & keys[2 * i + 1]) for i, p in enumerate(pairs) if p[0] == low] for low in {p[0] for p in pairs}}
    print({low: (sum(x), len(x)) for low, x in shared.items()})
    assert all(sum(x) >= 0.99 * len(x) for x in shared.values())


def all_pairs(lines):
    """The least line of each line's component, all pairs of lines compared."""
    least = {x: x for x in lines}
    links = [(a, b) for a in lines for b in lines if a < b and similarity(a, b) >= 0.8]
    for _ in lines:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_lines_with_few_or_no_blanks_are_compared(spark):
    r = random.Random(12)
    lines = []
    for alphabet, n in (("的一是不了人我在有他这中大来上个国", 40), ("การนวมเปยล", 60), ("abcdefgh", 30), ("xyz\t ", 50)):
        for _ in range(6):
            a = "/" + "".join(r.choice(alphabet) for _ in range(r.randint(n, 3 * n))) + "/"
            i = r.randrange(2, len(a) - 2)
            lines += [a, a[:i] + a[i + 1 :]]
    lines += ["abcd", "abce", "abcdefghi", "abcdefgh", "aaaaaaa", "aaaaaaaaaa", "12345 789 1234"]
    least = all_pairs(lines)
    first = {x: min(i for i, y in enumerate(lines) if least[y] == least[x]) for x in lines}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {q.doc_id for q in L.dedup_lines(docs, out="d").collect() if q.d.n_removed}
    assert len(gone) >= 20 and gone == {i for i, x in enumerate(lines) if first[x] != i}


def test_crowded_keys_are_compared_wholly(spark, monkeypatch):
    """Lines of one key that are near-equal to each other, but to neither of the key's partners."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(L, "CROWDED", 8)
    r = random.Random(13)
    pairs = similar_pairs(r, 10, 40, 80)
    lines = [x for p in pairs for x in p]
    docs = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    # One key for all.
    signed = store(L._signed(docs).withColumn("keys", F.array(F.lit(1).cast("long"))))
    named = {q.id: q.h for q in signed.collect()}
    links = {(q.u, q.v) for q in L.near_equal(docs, signed).collect()}
    assert links == {tuple(sorted((named[2 * i], named[2 * i + 1]))) for i in range(len(pairs))}


def test_keys_that_banding_does_not_part(spark, monkeypatch):
    """Lines made of one template: too alike to be parted, too different to be near-equal, but for a few."""
    monkeypatch.setattr(L, "CROWDED", 8)
    r = random.Random(14)
    base = [prose(r, 1) for _ in range(30)]
    lines = []
    for i in range(120):
        w = list(base)
        for k in r.sample(range(30), 5):
            w[k] = prose(r, 1)
        lines.append(" ".join(w))
        if i % 10 == 0:
            lines.append(lines[-1] + " q")
    lines += [" ".join(base) + f" {i}" for i in range(40)]
    least = all_pairs(lines)
    first = {x: min(i for i, y in enumerate(lines) if least[y] == least[x]) for x in lines}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {q.doc_id for q in L.dedup_lines(docs, out="d").collect() if q.d.n_removed}
    wanted = {i for i, x in enumerate(lines) if first[x] != i}
    assert gone <= wanted and len(gone) >= 0.97 * len(wanted)


def test_repetitive_long_lines(spark):
    lines = ["ab " * 900, "ab " * 300 + "ab", "abcdefgh " * 500, "abcdefgh " * 100, "x" * 5000, "x" * 4000, prose(random.Random(1), 3000)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {q.doc_id for q in L.dedup_lines(docs, out="d").collect() if q.d.n_removed} == {1, 3, 5}


def test_sketches_tell_near_equal_lines(spark):
    import pyarrow as pa

    from terrane.llm import shingles

    r = random.Random(15)
    pairs = [p for low, high in ((1, 6), (7, 30), (30, 200), (200, 2000)) for p in similar_pairs(r, low, high, 150)]
    _, times, s, t, _ = (x.to_pylist() for x in shingles.signed(pa.array([x for p in pairs for x in p])))
    bits = [((s[i] ^ s[i + 1]) & (1 << 64) - 1).bit_count() + ((t[i] ^ t[i + 1]) & (1 << 64) - 1).bit_count() for i in range(0, len(s), 2) if times[i] == times[i + 1]]
    assert len(bits) > 500 and max(bits) <= L.MOST_BITS


def test_similarity_is_exact():
    import pyarrow as pa

    from terrane.llm import shingles

    r = random.Random(16)
    pairs = [(a, b) for low, high in ((1, 6), (7, 30), (100, 400)) for a, b in similar_pairs(r, low, high, 60)]
    pairs += [(a, varied(r, varied(r, varied(r, a)))) for a, _ in pairs] + [("", "x"), ("😀" * 7, "😀" * 6), ("abcd", "abcd"), ("abcd", "abcde")]
    got = shingles.alike(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), 0.8)
    assert got.tolist() == [similarity(a, b) >= 0.8 for a, b in pairs]


def test_leaves_only_its_result_on_disk(spark):
    """Tables of the way, of keys, pairs and texts above all, go before the next step; a later one finds them gone."""
    from pathlib import Path

    from terrane.operators.lineage import checkpoint_folder

    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    files = lambda: {p: p.stat().st_size for p in folder.rglob("*") if p.is_file()}
    texts = [(i, "\n".join(f"line {i % 7} of a text with words {j} and more of the words {j * 37 % 101} {i % 3}" for j in range(20))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    before = files()
    gone = L.removed_lines(docs)
    left = {p: n for p, n in files().items() if p not in before}
    assert not [p for p in left if p.suffix == ".parquet"]
    assert gone.count() > 0 and sum(left.values()) < 200_000


def test_native_and_links_of_a_group_of_near_copies_grow_with_its_lines(spark):
    r = random.Random(17)
    base = prose(r, 60)
    lines = [f"{base} {prose(r, 1)}{i}" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    signed = L._signed(docs)
    plan = signed._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "Python" not in plan
    stored = store(signed)
    links = {(q.u, q.v) for q in L.near_equal(docs, stored).collect()}
    joined = {x for p in links for x in p}
    assert joined == {q.h for q in stored.collect()} and len(links) <= 12 * len(lines)


def test_bitmaps_let_all_near_equal_pairs_pass_and_hold_back_most_others(spark):
    """Variants of one line: bitmaps part those below the limit, so few are compared; lines of all kinds of sets of words."""
    from pyspark.sql import functions as F

    from terrane.operators.lineage import Scratch

    r = random.Random(18)
    pairs = [p for low, high, n in ((1, 6, 60), (7, 30, 60), (30, 200, 60), (600, 700, 5)) for p in similar_pairs(r, low, high, n)]
    pairs += [("ab " * 400, "ab " * 350), ("😀" * 7, "😀" * 6), ("abcd", "abcde"), ("x" * 3000, "x" * 3000 + "y")]
    base = prose(r, 60).split(" ")
    variants = []
    for _ in range(120):
        w = list(base)
        for k in r.sample(range(60), 8):
            w[k] = prose(r, 1)
        variants.append(" ".join(w))
    pairs += [(a, b) for i, a in enumerate(variants) for b in variants[:i]]
    near = {p for p in pairs if similarity(*p) >= 0.8}
    texts = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "line string").select(F.xxhash64("line").alias("h"), "line")
    named = {q.line: q.h for q in texts.collect()}
    marks = {q.h: q for q in L._marked(texts).collect()}
    assert all(marks[named[x]].n == len(shingles(x)) for x in named if "😀" not in x)
    frame = spark.createDataFrame([(named[a], named[b]) for a, b in pairs], "u long, v long")
    held = Scratch(spark)
    found = {(q.u, q.v) for q in L._likely(L._marked(texts), held.keep(frame), held).collect()}
    assert {(named[a], named[b]) for a, b in near} <= found and len(found) < len(near) + 0.1 * len(pairs)


def test_pairs_below_the_limit_are_no_rows_of_the_join(spark, monkeypatch):
    """Variants of one line that are near-equal to none of the others: their pairs went to the texts before."""
    r = random.Random(19)
    base = prose(r, 60).split(" ")
    lines = []
    for _ in range(150):
        w = list(base)
        for k in r.sample(range(60), 8):
            w[k] = prose(r, 1)
        lines.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    compared, whole = [], L._verified
    monkeypatch.setattr(L, "_verified", lambda texts, pairs, held: compared.append(pairs.count()) or whole(texts, pairs, held))
    L.near_equal(docs, store(L._signed(docs))).collect()
    assert compared and sum(compared) < 0.1 * 150 * 149 / 2
