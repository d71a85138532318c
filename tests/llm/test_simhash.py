import random

import numpy as np
import pytest
import xxhash
from terrane.llm import simhash as S
from terrane.llm import vptree

from .conftest import nasty_rows, prose


def by_definition(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    w = [x for x in w if x]
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(prints, ids, limit=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= limit:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(filter(lambda x: x is not None, (least.get(r), d)), default=None)
    return [least[find(i)] for i in range(len(prints))]


def test_fingerprint_matches_definition():
    r = random.Random(2)
    texts = [prose(r, n) for n in (1, 2, 3, 4, 5, 50, 400)] + ["", None, " \t ", "A B\x0bC\x0cD e", "É é", "a\xa0b c d e"]
    assert [S.fingerprint(t) for t in texts] == [by_definition(t) for t in texts]


@pytest.mark.parametrize("n", [3, 900, 6000])
def test_trees_find_all_links(n):
    r = np.random.default_rng(n)
    points = r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
    for copies in (points[: n // 4], np.full(n // 3, points[0])):
        near = copies.copy()
        for _ in range(4):
            near ^= np.uint64(1) << r.integers(0, 64, len(near), dtype=np.uint64)
        points = np.concatenate([points, near])
    points = np.unique(points)
    r.shuffle(points)
    want, got = np.arange(len(points)), np.arange(len(points))
    for at in range(0, len(points), 512):
        i, j = np.nonzero(np.bitwise_count(points[at : at + 512, None] ^ points[None, :]) <= 4)
        vptree._merge(want, i + at, j)
    for block in range(vptree.BLOCKS):
        tree, _ = vptree.build(points[:128], block, 8, np.random.default_rng(1))
        shards = {}
        for shard, home, at in vptree.route(tree, block, points):
            shards.setdefault(shard, {})[home] = at
        for shard, parts in shards.items():
            at = np.concatenate([parts[True], parts[False]])
            member, root = vptree.join_shard(points[at], len(parts[True]), block, shard)
            vptree._merge(got, at[member], at[root])
    assert np.array_equal(want, got)


def corpus():
    r = random.Random(9)
    rows = nasty_rows()
    for k in range(120):
        text = prose(r, r.randint(30, 200))
        rows.append((1000 + k, text, "s"))
        if k % 3 == 0:
            w = text.split(" ")
            w[r.randrange(len(w))] = "changed"
            rows.append((500 + k, " ".join(w), "s"))
    return rows


def test_components_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = sorted(((r.doc_id, r.fingerprint & (2**64 - 1), r.component_id) for r in S.link_documents(docs).collect()), key=str)
    prints = [by_definition(t) for _, t, _ in rows]
    want = sorted(zip([i for i, _, _ in rows], prints, groups(prints, [i for i, _, _ in rows]), strict=True), key=str)
    assert got == want


def test_hot_shards_in_parts_give_the_same(spark, monkeypatch):
    r = np.random.default_rng(8)
    points = np.full(3000, r.integers(0, 2**62), dtype=np.uint64)
    for _ in range(5):
        points ^= np.uint64(1) << r.integers(0, 64, len(points), dtype=np.uint64)
    points = np.unique(np.concatenate([points, r.integers(0, 2**62, 500, dtype=np.uint64)])).view(np.int64)
    rows = spark.createDataFrame([(i, int(p)) for i, p in enumerate(points)], "doc_id long, fp long")
    whole = sorted(map(tuple, S.near_duplicates(rows).collect()))
    monkeypatch.setattr(S, "SPLIT_ROWS", 300)
    assert sorted(map(tuple, S.near_duplicates(rows).collect())) == whole
    want = np.arange(len(points))
    for at in range(0, len(points), 512):
        i, j = np.nonzero(np.bitwise_count(points[at : at + 512, None].view(np.uint64) ^ points.view(np.uint64)[None, :]) <= 4)
        vptree._merge(want, i + at, j)
    assert len({c for _, c, _ in whole}) == len(set(want.tolist()))


def test_one_row_of_each_group_stays(spark, nasty):
    kept = S.keep_one(nasty)
    assert kept.columns == nasty.columns
    rows = nasty_rows()
    prints = [S.fingerprint(t) for _, t, _ in rows]
    want = sorted({str(c) for c in groups(prints, [i for i, _, _ in rows])})
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert S.keep_one(nasty.limit(0)).count() == 0
    assert S.link_documents(nasty).count() == len(rows)
