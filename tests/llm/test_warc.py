import gzip
import random
from collections import Counter, defaultdict

import pytest
from terrane.llm import warc as W

from tests.differential import connect, duck_rows, spark_rows

from .conftest import prose

SCHEMA = "page_id long, url string, html string"


def pages():
    r = random.Random(8)
    rows = [(i, f"http://a.example/{i}", f"<p>{prose(r, r.randint(1, 60))}</p>\r\n\r\nWARC/1.1 x") for i in range(40)]
    rows += [(100 + i, "http://b.example/\r\nWARC-Type: x é", rows[i % 3][2]) for i in range(12)]
    rows += [(101, None, rows[1][2]), (101, None, rows[1][2]), (None, "u", rows[2][2]), (None, None, None), (7, "", ""), (8, "x", None), (None, "y", "only here"), (None, "y", "only here")]
    return [*rows, (900, "long", "é" * 9_000_000), (901, "long", "é" * 9_000_000)]


def expected(rows, least=0):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = Counter()
    for h, ids in groups.items():
        data = h.encode()
        ids.sort(key=lambda i: (i is None, -(i or 0)))
        for k, i in enumerate(ids):
            again = k > 0 and len(data) >= least
            out[i, len(data), W.digest_of(data), "revisit" if again else "response", ids[0] if again else None] += 1
    return out


def got(frame):
    found = W.resolve(frame).collect()
    assert {x.problem for x in found} <= {None}
    to_int = lambda x: None if x is None else int(x)
    return Counter((to_int(x.page_id), x.payload_bytes, x.payload_digest, x.record_type, to_int(x.refers_to)) for x in found)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("warc") / "out")
    frame = spark.createDataFrame([(*x, "z", "z") for x in pages()], SCHEMA + ", payload string, `row` string").repartition(3)
    W.write_warc(frame, at, archive_bytes=3000)
    return at


def test_round_trip(spark, written):
    assert got(W.read_warc(spark, written, payloads=False)) == expected(pages())
    found = W.resolve(W.read_warc(spark, written)).collect()
    held = Counter((x.page_id, bytes(x.payload)) for x in found)
    assert held == Counter((None if i is None else str(i), (h or "").encode()) for i, _, h in pages())
    assert {x.target_uri for x in found if x.page_id == "103"} == {"http://b.example/%0D%0AWARC-Type:%20x%20é"} and None in {x.target_uri for x in found}
    assert len({x.record_id for x in found}) == len(found) and len({x.path for x in found}) > 6


def test_archives_are_gzip_members_a_record(spark, written):
    """Python's own gzip reads each archive, each record starts a member, and small archives end in time."""
    rows = W.read_warc(spark, written).collect()
    for path in {x.path for x in rows}:
        data = open(path.removeprefix("file:"), "rb").read()
        mine = sorted(x.offset for x in rows if x.path == path)
        assert len(set(mine)) == len(mine) and gzip.decompress(data).count(b"WARC-Record-ID") == len(mine) and mine[-1] < 6000
        for at, to in zip(mine, [*mine[1:], len(data)]):
            assert gzip.decompress(data[at:to]).startswith(b"WARC/1.1\r\n")


def test_small_payloads_are_responses(spark, tmp_path):
    W.write_warc(spark.createDataFrame(pages()[:60], SCHEMA), f"{tmp_path}/w", min_bytes=200)
    assert got(W.read_warc(spark, f"{tmp_path}/w")) == expected(pages()[:60], 200)


def test_damage_costs_one_record(written):
    data = b"".join(W.member_of(W.record_of({"record_id": str(i), "refers_to": None, "refers_uri": None, "uri": "u", "page_id": str(i), "payload": prose(random.Random(i), 50).encode()}, W.DATE)) for i in range(9))
    sound = list(W.records(data))
    assert [x["page_id"] for x in sound] == list("012345678")
    broken = bytearray(data)
    for k in range(12, 40):
        broken[sound[4]["offset"] + k] ^= 0x5A
    found = list(W.records(bytes(broken)))
    assert [x["page_id"] for x in found if not x.get("problem")] == list("01235678") and any(x.get("problem") for x in found)
    cut = list(W.records(data[: (sound[8]["offset"] + len(data)) // 2]))
    assert [x.get("page_id") for x in cut if not x["problem"]] == list("01234567") and cut[8]["problem"] == "the member ends early"
    wrong = gzip.compress(gzip.decompress(data[: sound[1]["offset"]]).replace(b"\r\n\r\nHTTP/1.1 200 OK", b"\r\n\r\nHTTP/1.1 200 KO"))
    assert [x["problem"] for x in W.records(wrong)] == ["the block's digest differs"]


@pytest.mark.parametrize("data, problem", [(b"hello", "the header has no end"), (b"x\r\n\r\n", "not a WARC record"), (b"WARC/1.0\r\na: b\r\n\r\n", "no content length"), (b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n", "the block's length isn't as stated")])
def test_what_is_no_record(data, problem):
    assert [x["problem"] for x in W.records(data)] == [problem] == [x["problem"] for x in W.records(gzip.compress(data))]


def test_other_archives():
    """Records without compression, several records in a member, other block types and digests."""
    one = b"WARC/1.0\r\nWARC-Type: metadata\r\nwarc-record-id: <urn:uuid:a>\r\nWARC-Block-Digest: sha256:00\r\nContent-Length: 5\r\n\r\na\r\nbc\r\n\r\n"
    for data in (one * 3, gzip.compress(one * 3), gzip.compress(b"") + gzip.compress(one) + gzip.compress(one * 2)):
        assert [(x["record_type"], x["record_id"], x["payload"], x["problem"]) for x in W.records(data)] == [("metadata", "a", b"a\r\nbc", None)] * 3
    assert list(W.records(b"")) == []


def test_a_missing_response_is_a_problem(spark, written):
    rows = W.read_warc(spark, written)
    found = W.resolve(rows.where("record_type = 'revisit' or payload_bytes > 1000000"))
    assert {(x.payload_bytes or 0) > 1000000 for x in found.where("problem is null").collect()} == {True}
    assert {x.problem for x in found.where("payload_bytes is null").collect()} == {"the response is missing"}


def test_query(spark, tmp_path):
    from terrane.llm.oracles import ORACLES
    from terrane.llm.queries import QUERIES

    spark.createDataFrame(pages(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["op11_warc"](spark, str(tmp_path))
    assert Counter(tuple(x) for x in found.collect()) == expected(pages())
    assert spark_rows(found) == duck_rows(connect(str(tmp_path)), ORACLES["op11_warc"])
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert QUERIES["op11_warc"](spark, f"{tmp_path}/none").collect() == []
