"""SimHash near-duplicates, found by vantage-point trees.

Fingerprints are counted once each; their trees' shards hold home fingerprints and the visitors that
the triangle bounds call for (``vptree``). Shards emit at most one link a member, and the links'
components are found by distributed contraction, so large groups of copies make neither all pairs nor
one large task: exact copies are one fingerprint, and near copies are pruned once they are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import vptree
from terrane.llm.text import small_batches, with_output
from terrane.operators.components import connected_components
from terrane.operators.lineage import cut

SHINGLE, SEED = 4, 42
#: Home fingerprints of a shard, on average; shards of a block are at most MAX_SHARDS.
SHARD_ROWS, MIN_SHARDS, MAX_SHARDS = 12_000, 8, 4096
#: A shard of more rows is searched in parts: each takes some home points, and meets all later ones.
SPLIT_ROWS = 8 * SHARD_ROWS
#: Fingerprints that the sharding trees are fitted to, for each shard.
SAMPLE_PER_SHARD = 16


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def add_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint (long, its bits as they are) in column ``out``."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(x) for x in batch], np.uint64).view(np.int64))

    return with_output(small_batches(docs), out, prints(docs[text_col]))


def _links(prints: DataFrame) -> DataFrame:
    """u, v: links between distinct fingerprints whose components are those of all pairs within LIMIT bits."""
    n = prints.count()
    shards = int(min(MAX_SHARDS, max(MIN_SHARDS, -(-n // SHARD_ROWS))))
    sample = prints.orderBy(F.xxhash64("fp", F.lit(SEED))).limit(shards * SAMPLE_PER_SHARD).select("fp").collect()
    points = np.array([r[0] for r in sample], np.int64).view(np.uint64)
    trees, first = [], 0
    for block in range(vptree.BLOCKS):
        tree, first = vptree.build(points, block, shards, np.random.default_rng(SEED + block), first)
        trees.append((block, tree, first))

    def dealer(parts: dict[int, int]):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(0).to_numpy(zero_copy_only=False)
                for block, tree, _ in trees:
                    for shard, home, at in vptree.route(tree, block, values.view(np.uint64)):
                        if len(at):
                            yield from rows_of(shard, home, values[at], parts.get(shard, 1))

        return prints.select("fp").mapInArrow(deal, "shard int, part int, home boolean, fp long")

    def rows_of(shard: int, home: bool, values: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
        own = (values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts) if home else np.full(len(values), parts, np.uint64)
        for part in range(parts):
            here = own >= part
            yield pa.record_batch([pa.array(np.full(here.sum(), shard, np.int32)), pa.array(np.full(here.sum(), part, np.int32)), pa.array(own[here] == part), pa.array(values[here])], names=["shard", "part", "home", "fp"])

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = next(b for b, _, end in trees if key[0] < end)
        rows = rows.sort_values(["home", "fp"], ascending=[False, True], kind="stable")
        values = rows["fp"].to_numpy()
        member, root = vptree.join_shard(values.view(np.uint64), int(rows["home"].sum()), block, int(key[0]))
        return pd.DataFrame({"u": values[member], "v": values[root]})

    sizes = dealer({}).groupBy("shard").count().where(F.col("count") > SPLIT_ROWS).collect()  # at most one row a shard
    dealt = dealer({r["shard"]: -(-r["count"] // SPLIT_ROWS) for r in sizes})
    return dealt.groupBy("shard", "part").applyInPandas(search, "u long, v long")


def near_duplicates(fingerprinted: DataFrame) -> DataFrame:
    """From doc_id, fp (any number of rows, nulls in doc_id allowed): fp, component_id, keeper_fp; one row a fingerprint.

    component_id is the smallest doc_id among documents linked to the fingerprint through pairs of at
    most LIMIT differing bits; keeper_fp the least fingerprint that a row of that doc_id has. Null ids
    are never the smallest, unless there are no others. An empty table gives no rows.
    """
    prints = cut(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    groups = connected_components(_links(prints)).select(F.col("node").alias("_node"), F.col("component").alias("c"))
    labelled = prints.join(groups, prints["fp"] == groups["_node"], "left").select("fp", "first_id", F.coalesce("c", "fp").alias("c"))
    least = labelled.groupBy("c").agg(F.min(F.struct(F.col("first_id").isNull().alias("n"), "first_id", "fp")).alias("m"))
    return labelled.join(least, "c").select("fp", F.col("m.first_id").alias("component_id"), F.col("m.fp").alias("keeper_fp"))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, fingerprint (long), component_id.

    A null or empty text has fingerprint 0 and is linked like any other; fewer words than a shingle are
    one shingle. Repeated rows are returned each. Other columns are left out, so none can clash.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(add_fingerprints(slim, "text", "fp").select("doc_id", "fp"))
    return rows.join(near_duplicates(rows), "fp").select(F.col("doc_id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id, whole and unchanged."""
    # Fingerprints are made once and stored beside the ids: texts needn't be hashed again to be picked.
    rows = cut(add_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "fp").select("doc_id", "fp"))
    groups = cut(near_duplicates(rows))
    keepers = groups.where("fp = keeper_fp").select(F.col("fp").alias("_k"), F.col("component_id").alias("_c"))
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(keepers.select("_c"), docs[id_col].eqNullSafe(F.col("_c")), "left_semi")
    # Rows that share an id are told apart by their fingerprints; where these are the same too, one of them is picked.
    marked = add_fingerprints(docs, text_col, "_fp")
    kept = marked.join(keepers, (marked["_fp"] == keepers["_k"]) & marked[id_col].eqNullSafe(keepers["_c"])).drop("_k", "_c")
    if not rows.groupBy("doc_id", "fp").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_fp"])
    return kept.drop("_fp")
