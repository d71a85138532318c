"""Token counts by scanning flat, unindexed token files for separators.

A flat token file is a run of fixed-width token ids in which an end-of-document id closes each
document; it has no index. It is read in blocks that ignore document boundaries. Every block finds its
separators in one vectorised comparison and reports its closed lengths, its head (tokens before the
first separator) and its tail (after the last). A prefix scan over a file's blocks then gives every
block the tokens left open before it and the number of documents before it, and so stitches documents
across any number of blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.llm.text import small_batches
from terrane.operators.lineage import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pretokenizer pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_DOCUMENT, WIDTH = 50256, "<u2"
BLOCK_TOKENS = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoder(ranks: dict[bytes, int]):
    """Function from text to token ids."""
    import tiktoken

    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def pack(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token blocks of the documents: file, block, data (ids of WIDTH) and, apart, the ids by position.

    A file holds one input partition's documents in order, each closed by the separator. Rows with data
    are blocks; rows with ids name the documents from position ``block`` on. Blocks leave the packer as
    they are full, so memory doesn't grow with a document's file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoder(shared.value), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        size = block = seen = 0

        def row(number: int, data: bytes | None, ids) -> pa.RecordBatch:
            return pa.record_batch([pa.array([file], pa.int32()), pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.string()))], names=["file", "block", "data", "ids"])

        for batch in batches:
            ids = batch.column(0).cast(pa.string()).to_pylist()
            yield row(seen, None, ids)
            seen += len(ids)
            for text in batch.column(1).to_pylist():
                got = encode(text or "")
                got.append(END_OF_DOCUMENT)
                held.append(np.array(got, WIDTH))
                size += len(got)
                while size >= block_tokens:
                    flat = np.concatenate(held)
                    yield row(block, flat[:block_tokens].tobytes(), None)
                    block, held, size = block + 1, [flat[block_tokens:]], size - block_tokens
        if size:
            yield row(block, np.concatenate(held).tobytes(), None)

    slim = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(packed, "file int, block long, data binary, ids array<string>")


def read_flat(spark: SparkSession, path: str, block_bytes: int = 2 * BLOCK_TOKENS) -> DataFrame:
    """Blocks of the flat token files at ``path``, through Spark's own reader: file (its path), block, data.

    A block is cut from the file's bytes inside the scan; a file is one row of the reader first, so flat
    files are to be written in parts of at most about a gigabyte.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_buffer()
                for at in range(0, data.size, block_bytes):
                    yield pa.record_batch([pa.array([file.as_py()]), pa.array([at // block_bytes], pa.int64()), pa.array([data.slice(at, min(block_bytes, data.size - at)).to_pybytes()], pa.binary())], names=["file", "block", "data"])

    return files.mapInArrow(blocks, "file string, block long, data binary")


def scan(blocks: DataFrame, separator: int = END_OF_DOCUMENT, width: str = WIDTH) -> DataFrame:
    """Of each block: file, block, n_tokens, n_ends, head, tail, inner (lengths between its separators); ids are passed on.

    Without a separator, head and tail are both the whole block.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    with_ids = "ids" in blocks.columns

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2):
                if not data.is_valid:
                    rows.append((None, None, None, None, None))
                    continue
                tokens = np.frombuffer(data.as_buffer(), width)
                ends = np.flatnonzero(tokens == separator)
                n = len(tokens)
                rows.append((n, len(ends), int(ends[0]) if len(ends) else n, int(n - 1 - ends[-1]) if len(ends) else n, np.diff(ends) - 1))
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)] + [pa.array([r[4] for r in rows], pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(1), *cols, *([batch.column(3)] if with_ids else [])], names=["file", "block", "n_tokens", "n_ends", "head", "tail", "inner", *(["ids"] if with_ids else [])])

    return blocks.mapInArrow(found, f"file {kind}, block long, n_tokens long, n_ends long, head long, tail long, inner array<bigint>" + (", ids array<string>" if with_ids else ""))


def stitch(scanned: DataFrame) -> DataFrame:
    """file, place (of the document in its file, from 0), n_tokens: the prefix scan over each file's blocks.

    Tokens after a file's last separator are a last document of their own. A file has one row a block here.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(F.col("n_tokens"))
    runs = scanned.withColumn("run", F.sum((F.col("n_ends") > 0).cast("int")).over(upto)).withColumn("docs_before", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    held = runs.withColumn("held", F.sum(open_).over(Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    carried = held.withColumn("carry", F.coalesce(F.lag("held").over(order), F.lit(0))).withColumn("last", F.lead("block").over(order).isNull())
    lengths = F.concat(
        F.when(F.col("n_ends") > 0, F.concat(F.array(F.col("carry") + F.col("head")), "inner")).otherwise(F.array().cast("array<bigint>")),
        F.when(F.col("last") & (F.col("held") > 0), F.array("held")).otherwise(F.array().cast("array<bigint>")),
    )
    return carried.select("file", "docs_before", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("docs_before") + F.col("i")).alias("place"), "n_tokens")


def count_tokens(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per document: id_col, n_tokens, counted in the flat token files that the documents are packed into.

    A null or empty text has 0 tokens. Repeated rows are returned each; other columns are left out, so
    none can clash. An empty table gives no rows.
    """
    scanned = cut(scan(pack(docs, path, id_col, text_col, block_tokens)))
    lengths = stitch(scanned.where("n_tokens is not null").drop("ids"))
    names = scanned.where("ids is not null").select("file", "block", F.posexplode("ids").alias("i", "id")).select("file", (F.col("block") + F.col("i")).alias("place"), "id")
    kind = docs.schema[id_col].dataType
    return names.join(lengths, ["file", "place"]).select(F.col("id").cast(kind).alias(id_col), "n_tokens")
