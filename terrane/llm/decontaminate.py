"""Benchmark decontamination by winnowing.

Both sides keep, in every window of ``WINDOW`` consecutive k-grams, the k-gram of least hash. Two
texts that share ``GRAM + WINDOW - 1`` = 13 words share such a window and so its least k-gram,
hence every shared span of 13 words is found. Fingerprints are joined; each match names a diagonal
(document position less item position), which is extended word by word over the whole item, so
hashes decide nothing. Items of under 13 words are one window: for each of the at most 12 such
lengths in use, all k-grams of that length are kept, which is winnowing with a window of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import lower_ascii, split_words
from terrane.operators.lineage import cut

SPAN, GRAM = 13, 7
WINDOW = SPAN - GRAM + 1
#: A fingerprint is a 33-bit hash above a 30-bit position: a text's array can't be longer.
POSITION_BITS, HASH_MASK = 30, (1 << 33) - 1
#: Benchmark fingerprints are broadcast up to this many rows of 24 bytes; more are shuffled.
BROADCAST_ROWS = 200_000


def _gram(length: int, kind: int) -> str:
    return f"(xxhash64({', '.join(f'h[i+{j}]' for j in range(length))}, {kind}) & {HASH_MASK})"


def _packed(length: int, kind: int) -> str:
    """Array over positions of hash and position in one long; empty for shorter texts."""
    made = f"transform(sequence(0, size(h)-{length}), i -> (shiftleft({_gram(length, kind)}, {POSITION_BITS}) | i))"
    return f"if(size(h) >= {length}, {made}, array())"


def _fingerprints(words: Column, short: list[int], ids: list[Column], docs: DataFrame) -> DataFrame:
    """A document's kept k-grams (hash f, word position p): the first least of each window."""
    hashed = docs.select(*ids, F.transform(words, lambda w: F.xxhash64(w)).alias("h"))
    grams = hashed.select(*docs_ids(ids), F.col("h"), F.expr(_packed(GRAM, SPAN)).alias("v"))
    least = ", ".join(f"v[i+{j}]" for j in range(WINDOW))
    kept = [f"if(size(v) >= {WINDOW}, array_distinct(transform(sequence(0, size(v)-{WINDOW}), i -> least({least}))), array())"]
    kept += [_packed(n, n) for n in short]
    all_kept = kept[0] if len(kept) == 1 else f"concat({', '.join(kept)})"
    return (
        grams.select(*docs_ids(ids), F.explode(F.expr(all_kept)).alias("x"))
        .select(*docs_ids(ids), F.shiftright("x", POSITION_BITS).alias("f"), F.expr(f"int(x & {(1 << POSITION_BITS) - 1})").alias("p"))
    )


def docs_ids(ids: list[Column]) -> list[Column]:
    """The id columns by their names."""
    return [F.col(f"_{i}") for i in range(len(ids))]


def _item_fingerprints(items: DataFrame, short: list[int]) -> DataFrame:
    """All least k-grams of each window, ties included, so that ties can't hide a shared window."""
    hashed = items.select("key", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    long = (
        hashed.where(f"size(h) >= {SPAN}")
        .select("key", F.expr(f"transform(sequence(0, size(h)-{GRAM}), i -> {_gram(GRAM, SPAN)})").alias("g"))
        .select("key", "g", F.expr(f"transform(sequence(0, size(g)-{WINDOW}), i -> array_min(slice(g, i+1, {WINDOW})))").alias("m"))
        .select(
            "key", "g",
            F.explode(F.expr(
                f"filter(sequence(0, size(g)-1), j -> exists(sequence(greatest(0, j-{WINDOW - 1}), least(j, size(m)-1)), i -> m[i] = g[j]))"
            )).alias("q"),
        )
        .select("key", F.expr("g[q]").alias("f"), "q")
    )
    for n in short:
        whole = hashed.where(f"size(h) = {n}").select("key", F.expr(_gram(n, n).replace("i+", "")).alias("f"), F.lit(0).alias("q"))
        long = long.unionByName(whole)
    return long


def _runs(words: str, d: str) -> str:
    """SQL for the runs (s, e) of document words ``w`` on diagonal ``d`` that hold whole windows of an item's words."""
    differ = f"filter(sequence(0, size({words}) - 1), j -> not coalesce(get(w, {d} + j) = {words}[j], false))"
    made = f"transform(sequence(1, size(c) - 1), i -> struct({d} + c[i - 1] + 1 as s, {d} + c[i] as e))"
    return f"transform(array(concat(array(-1), {differ}, array(size({words})))), c -> filter({made}, r -> r.e - r.s >= least(size({words}), {SPAN})))[0]"


def _joined(places: str) -> str:
    """SQL for the runs (s, e; e past the end) of consecutive numbers among ``places``, which are sorted and distinct."""
    starts = "filter(o, (x, k) -> k = 0 or o[k - 1] < x - 1)"
    ends = "filter(o, (x, k) -> k = size(o) - 1 or o[k + 1] > x + 1)"
    return f"transform(array({places}), o -> zip_with({starts}, {ends}, (x, y) -> struct(x as s, y + 1 as e)))[0]"


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", out: str = "contamination",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, spans (s, e in words; e past the end), items.

    ``spans`` are the covered runs of words by benchmark windows, sorted; ``items`` the distinct ids of
    items with an occurring window, as sorted strings. A null or empty text has no words and no hits.
    Rows that share a document id, or have none, are judged each by its own text. Items without words
    never match; a null item id counts in n_hit but can't be listed. Repeated items count once. An
    empty benchmark or an empty table gives zeros or no rows. An input column called ``out`` is replaced.
    """
    items = cut(
        benchmark.select(F.col(item_col).cast("string").alias("item"), split_words(lower_ascii(F.col(item_text_col))).alias("words"))
        .where("size(words) > 0").distinct().withColumn("key", F.monotonically_increasing_id())
    )
    short = sorted(r[0] for r in items.where(f"size(words) < {SPAN}").select(F.size("words")).distinct().collect())
    index = cut(_item_fingerprints(items, short))
    small = index.count() <= broadcast_rows
    hint = F.broadcast if small else (lambda x: x)
    fits = hint(items) if small and items.agg(F.sum(F.size("words"))).first()[0] in range(4 * broadcast_rows) else items

    words = split_words(lower_ascii(F.col(text_col)))
    prints = _fingerprints(words, short, [F.col(id_col).alias("_0")], docs)
    hits = cut(
        prints.join(hint(index), "f")
        .select("_0", "key", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
        .groupBy("_0", "key").agg(F.collect_list("diagonal").alias("d")).join(fits, "key")
        .groupBy("_0").agg(F.collect_list(F.struct("item", "words", "d")).alias("_hits"))
    )
    # Few hits go to where the texts are; more meet them in a shuffle.
    weight = hits.agg(F.sum(F.expr("1 + aggregate(_hits, 0, (a, h) -> a + size(h.words) + size(h.d))"))).first()[0] or 0
    here = F.broadcast(hits) if weight <= 4 * broadcast_rows else hits
    joined = docs.join(here, docs[id_col].eqNullSafe(here["_0"]), "left").drop("_0")
    tokens = joined.withColumn("_w", split_words(lower_ascii(joined[text_col])))
    runs = tokens.withColumn("_hits", F.expr(
        f"filter(transform(array(_w), w -> transform(_hits, h -> struct(h.item as item, flatten(transform(h.d, d -> {_runs('h.words', 'd')})) as runs)))[0], h -> size(h.runs) > 0)"
    ))
    places = "array_sort(array_distinct(flatten(transform(flatten(transform(_hits, h -> h.runs)), r -> sequence(r.s, r.e - 1)))))"
    spans = runs.withColumn("_places", F.expr(f"coalesce({places}, cast(array() as array<int>))"))
    value = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.size("_places").cast("long").alias("n_hit"),
        F.expr(f"if(size(_places) > 0, {_joined('_places')}, cast(array() as array<struct<s:int,e:int>>))").alias("spans"),
        F.expr("coalesce(array_sort(array_distinct(filter(transform(_hits, h -> h.item), x -> x is not null))), cast(array() as array<string>))").alias("items"),
        F.expr("size(array_distinct(coalesce(transform(_hits, h -> h.item), cast(array() as array<string>))))").cast("long").alias("n_items"),
    )
    kept = [spans[f"`{c}`"] for c in docs.columns if c.lower() != out.lower()]
    return spans.select(*kept, value.alias(out))


def contaminated(n_hit: Column, n_words: Column, parts: int = 20) -> Column:
    """Some word is hit, and hits are at least one word in ``parts``."""
    return (n_hit > 0) & (parts * n_hit >= n_words)
