"""WARC archives of pages: written with one gzip member a record, read record by record.

Spark's text writer writes the archives, so tasks may be retried: a row is a gzip member without its
last byte, and the line separator is that byte. A member ends in its size, lowest byte first, so the
byte is zero for records under 16 MB; a longer record is followed by an empty member, which reads as
nothing and does end in zero. Archives end at ``ARCHIVE_BYTES``, so that one fits a task's memory.

The reader inflates one member after the other, in steps, and cuts records by their Content-Length. A
member that is damaged costs its own records only: reading goes on at the next member.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.text import bounded, small_batches
from terrane.operators.lineage import cut, store

#: Compressed bytes of an archive, but for its last record; bytes that are inflated at once; bytes of a record's header at most.
ARCHIVE_BYTES, STEP, HEADER_BYTES = 32 << 20, 1 << 16, 1 << 20
#: A fixed date makes reruns equal.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP, MAGIC = 31, b"\x1f\x8b\x08"

RECORD = "path string, offset long, record_id string, record_type string, target_uri string, date string, page_id string, refers_to_record string, payload_bytes long, payload_digest string, payload binary, problem string"


def digest_of(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member_of(data: bytes) -> bytes:
    """``data`` as a gzip member whose last byte is zero; see the module."""
    zipper = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    made = zipper.compress(data) + zipper.flush()
    if made[-1]:
        zipper = zlib.compressobj(6, zlib.DEFLATED, GZIP)
        made += zipper.flush()
    return made


def header_value(text: str) -> str:
    """A value for one header line: what would break the line is percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in text)


def record_of(row: dict, date: str) -> bytes:
    """A response with its payload, or a revisit, which has the same HTTP header and no payload."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = row["refers_to"] is not None
    block = http if again else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <urn:uuid:{row['record_id']}>", f"WARC-Date: {date}"]
    lines += [f"{name}: {header_value(row[c])}" for name, c in (("WARC-Target-URI", "uri"), ("Page-ID", "page_id")) if row[c] is not None]
    lines += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}"]
    if again:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{row['refers_to']}>"]
        lines += [f"WARC-Refers-To-Target-URI: {header_value(row['refers_uri'])}"] if row["refers_uri"] is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes one record per row of ``pages`` to archives under ``path``.

    Of rows with equal payloads (SHA-1 and length) of at least ``min_bytes``, that with the largest id is the
    response (of repeated ids, one row of them; a null id is smallest), and the others revisit it. Smaller payloads are all responses. Null
    html is an empty payload, a null url or id leaves its header out. Other columns are left out. An empty
    table writes no archive.
    """
    payload = F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b""))
    rows = store(pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("uri"), payload.alias("payload"),
        F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"),
    ))
    rows = rows.withColumn("digest", F.when(F.col("size") >= min_bytes, F.concat_ws("-", "digest", "size")))
    groups = rows.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row", "uri")).alias("top"))
    tops = bounded(cut(groups.where("n > 1").select("digest", F.col("top.row").alias("top_row"), F.col("top.uri").alias("top_uri"))))
    uuid = lambda row: F.regexp_replace(F.md5(row.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    again = F.col("top_row") != F.col("row")
    made = rows.join(tops, "digest", "left").select(
        uuid(F.col("row")).alias("record_id"), F.when(again, uuid(F.col("top_row"))).alias("refers_to"), F.when(again, F.col("top_uri")).alias("refers_uri"), "uri", F.col("id").cast("string").alias("page_id"), "payload"
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            for at in range(batch.num_rows):
                member = member_of(record_of({c: batch.column(c)[at].as_py() for c in batch.schema.names}, date))
                yield pa.RecordBatch.from_arrays([pa.array([written // archive_bytes], pa.int32()), pa.array([member[:-1]], pa.binary())], names=["archive", "member"])
                written += len(member)

    archived = small_batches(made).mapInArrow(members, "archive int, member binary").select("archive", F.col("member").cast("string"))
    archived.write.partitionBy("archive").option("lineSep", "\0").text(path)


def inflated(data: bytes, at: int, ends: list[int]) -> Iterator[bytes]:
    """Pieces of the gzip member that starts at ``at``, whose end goes to ``ends``; all of ``data`` if it isn't compressed."""
    if data[at : at + 2] != MAGIC[:2]:
        for k in range(at, len(data), STEP):
            yield data[k : k + STEP]
        ends.append(len(data))
        return
    unzip = zlib.decompressobj(GZIP)
    while not unzip.eof:
        if at >= len(data):
            raise ValueError("the member ends early")
        piece = data[at : at + STEP]
        yield unzip.decompress(piece)
        at += len(piece) - len(unzip.unused_data)
    ends.append(at)


def framed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of each record, cut by Content-Length."""
    held = bytearray()

    def hold(n: int) -> bool:
        while len(held) < n and (piece := next(pieces, None)) is not None:
            held.extend(piece)
        return len(held) >= n

    while hold(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if len(held) > HEADER_BYTES or not hold(len(held) + 1):
                raise ValueError("the header has no end")
        first, *lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        if not headers.get("content-length", "").isdigit():
            raise ValueError("no content length")
        stop = end + 4 + int(headers["content-length"])
        if not hold(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("the block's length isn't as stated")
        yield headers, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def differs(stated: str | None, data: bytes) -> bool:
    """Whether a stated digest is a SHA-1 in base32, and not that of ``data``."""
    kind, _, value = (stated or "").partition(":")
    return kind.lower() == "sha1" and len(value) == 32 and value.upper() != digest_of(data)


def parsed(headers: dict[str, str], block: bytes, keep: bool) -> dict:
    """A record's columns; digests are verified, that of a revisit's payload is taken as stated."""
    bare = lambda name: (headers.get(name) or "").removeprefix("<urn:uuid:").removesuffix(">") or None
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    full, stated = headers.get("warc-type") != "revisit", headers.get("warc-payload-digest")
    problem = "the block's digest differs" if differs(headers.get("warc-block-digest"), block) else "the payload's digest differs" if full and differs(stated, payload) else None
    return {
        "record_id": bare("warc-record-id"), "record_type": headers.get("warc-type"), "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "page_id": headers.get("page-id"),
        "refers_to_record": bare("warc-refers-to"), "payload_bytes": len(payload) if full else None, "payload_digest": digest_of(payload) if full else (stated or "").partition(":")[2] or None,
        "payload": payload if full and keep else None, "problem": problem,
    }


def records(data: bytes, keep: bool = True) -> Iterator[dict]:
    """All records of an archive (gzip members or plain) in order; a damaged member gives what comes before the damage, and a row with its problem."""
    at = 0
    while 0 <= at < len(data):
        ends: list[int] = []
        try:
            for headers, block in framed(inflated(data, at, ends)):
                yield {"offset": at} | parsed(headers, block, keep)
            at = ends[0]
        except (ValueError, zlib.error) as e:
            yield {"offset": at, "problem": str(e)}
            at = data.find(MAGIC, at + 1)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record of all archives under ``path``: see ``RECORD``; ``problem`` is null for a sound record.

    An archive is read by one task, so it should fit an executor's memory as those written here do; empty
    archives give no rows. Without ``payloads`` the payloads are verified and measured, but not returned.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rows, held = [], 0
                for row in records(batch.column("content")[at].as_py(), payloads):
                    rows.append({c: row.get(c) for c in names} | {"path": batch.column("path")[at].as_py()})
                    held += len(row.get("payload") or b"")
                    if len(rows) == 1000 or held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    archives = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return small_batches(archives).mapInArrow(read, RECORD)


def resolve(found: DataFrame) -> DataFrame:
    """``found`` with refers_to (the page id of the response that a revisit refers to), and revisits with that response's payload and its size.

    A revisit whose response is missing or has another digest has that as its problem.
    """
    there = found.where("record_type <> 'revisit'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"), F.col("payload").alias("_payload"))
    again = found.where("record_type = 'revisit'").join(there, F.col("refers_to_record") == F.col("_id"), "left")
    wrong = F.when(F.col("_id").isNull(), "the response is missing").when(~F.col("payload_digest").eqNullSafe(F.col("_digest")), "the response has another digest")
    new = {"payload": F.col("_payload"), "payload_bytes": F.col("_bytes"), "problem": F.coalesce("problem", wrong)}
    resolved = again.select(*[new.get(c, F.col(c)).alias(c) for c in found.columns], F.col("_page").alias("refers_to"))
    return resolved.unionByName(found.where("record_type is null or record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("string")))
