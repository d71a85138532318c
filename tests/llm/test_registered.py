"""The registered queries, called by their names on a small table, against brute force."""

import random
import zlib
from collections import defaultdict

import pytest
from terrane.llm import tokens as T
from terrane.llm.queries import QUERIES

from .conftest import prose
from .test_lines import brute as line_brute
from .test_lines import content, varied
from .test_mixing import water_fill
from .test_simhash import by_definition, groups

SMALL = "/root/testdata/sf0.001"


def rows():
    r = random.Random(21)
    texts = ["\n".join(prose(r, r.randint(1, 25)) for _ in range(r.randint(1, 4))) for _ in range(30)]
    texts += [texts[0], "\n".join(varied(r, x) for x in texts[1].split("\n")), texts[2] + " x", "", None, " \n", "Ab cd", texts[3] + "\n" + texts[4]]
    return [(i, t, f"s{i % 4}") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("registered")
    spark.createDataFrame(rows(), "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    return str(at)


def got(spark, folder, name):
    return {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}


def test_op2(spark, folder):
    found = got(spark, folder, "op2_simhash")
    prints = [by_definition(t) for _, t, _ in rows()]
    least = groups(prints, [i for i, _, _ in rows()])
    assert {i: (r.fingerprint, r.component_id) for i, r in found.items()} == {i: (f"{p:016x}", c) for (i, _, _), p, c in zip(rows(), prints, least, strict=True)}


def test_op6(spark, folder):
    encode = T.encoder(T.load_ranks(T.VOCABULARY))
    assert {i: r.n_tokens for i, r in got(spark, folder, "op6_token_counts").items()} == {i: len(encode(t or "")) for i, t, _ in rows()}


def test_op8(spark, folder):
    found, keeper = got(spark, folder, "op8_line_dedup"), line_brute([(i, t) for i, t, _ in rows()])
    removed = 0
    for i, t, _ in rows():
        lines = [content(x) for x in (t or "").split("\n") if content(x)]
        left = [content(x) for x in (found[i].text or "").split("\n") if content(x)]
        assert found[i].n_lines == len(lines) and found[i].n_removed == len(lines) - len(left)
        for x in set(lines):
            low, sure = keeper[x]
            assert x not in left if low != i else not sure or left.count(x) == 1
        removed += found[i].n_removed
    assert removed > 8


def test_op10(spark, folder):
    found, sizes = got(spark, folder, "op10_mixing"), defaultdict(int)
    for _, t, s in rows():
        sizes[s] += len((t or "").split())
    target, taken = water_fill(sizes), defaultdict(int)
    for i, t, s in rows():
        r = found[i]
        assert r.size == len((t or "").split()) and r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * (1 + r.target) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    least = {s: min(found[i].size for i, _, x in rows() if x == s and found[i].size) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= least[s] for s in sizes), (taken, target)
    assert found == got(spark, folder, "op10_mixing")


def test_op4(spark):
    found = got(spark, SMALL, "op4_toxicity")
    docs = {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()}
    assert found.keys() == docs
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op5(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in QUERIES["op5_html_text"](spark, SMALL).collect():
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) and r.text == "\n".join(" ".join(x.split()) for x in r.text.split("\n"))


@pytest.mark.parametrize("name", ["op1_decontaminate", "op3_host_quality", "op9_url_filter"])
def test_those_with_sql(spark, name):
    from terrane.llm.oracles import ORACLES

    from tests.differential import connect, duck_rows, spark_rows

    assert spark_rows(QUERIES[name](spark, SMALL)) == duck_rows(connect(SMALL), ORACLES[name])
