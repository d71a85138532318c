"""Line dedup by MinHash, one line kept of each component of near-equal lines; SQL functions alone.

Lines are compared by their sets of 5-character shingles. Lines of MANY long words and more are banded by
these words: edits that leave a similarity of 0.8 change few of them, and they are far fewer than the
shingles. Lines of fewer words, or of words so long that an edit in each would pass, are banded by their
shingles; lines between the two have both kinds of keys, so they meet either neighbour. A key is the hash of
the least hashes from one of the marks of the hashes' ring on (one-permutation MinHash); sets of up to
ALL_RUNS have all their runs as keys, so near-equal ones surely meet.

Lines that share a key are compared with the key's least line first, by the exact Jaccard similarity, and
links are joined by distributed union-find (star contraction): as many pairs as lines in keys, whatever the
size of a group. Only lines that are in one key and still apart are compared after that: with all of the
key, if few lines are outside its largest component; otherwise the key's lines are banded again within it,
by other hashes, until keys are small or banding no longer parts them. There is no cap: a link is lost only
if two lines share no key.

Lines that share keys have a bitmap of their shingles, which bounds from above how many two of them have in
common: pairs that can't reach SIMILARITY go before their texts are fetched, within the join on keys.

Equal lines are one node throughout (their 64-bit hash: of n distinct lines, n * n / 2^65 pairs are taken
for equal by chance, one in 10^10 distinct lines about), so copies cost nothing but a count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import bounded
from terrane.operators.components import connected_components
from terrane.operators.lineage import Scratch, cut, release

SIMILARITY, SHINGLE = 0.8, 5
#: Bands and rows of keys by shingles; sets of LONG shingles and more have keys of ROWS hashes, sets of up to SHORT (LONG = 0.8 * SHORT) of SHORT_ROWS.
BANDS, ROWS, SHORT_ROWS, LONG, SHORT = 12, 5, 4, 48, 60
#: Every run is a key in sets of up to so many.
ALL_RUNS = 24
#: Longer lines keep the shingles' hashes next to the marks only, SAMPLE / 2 to SAMPLE of them: the runs are the same ones.
SAMPLE = 192
#: Bands and rows of keys by words of WORD bytes and more.
WORD_BANDS, WORD_ROWS, WORD = 14, 4, 5
#: Lines of FEW long words and more have keys by words, of less than MANY also by shingles, and so with lines of up to WIDER and more than WIDE characters a word.
FEW, MANY, WIDE, WIDER = 9, 14, 10, 15
#: Keys with more lines outside their largest component are banded again, with AGAIN bands of AGAIN_ROWS; pairs of a key are dealt out in parts of SALTED lines.
CROWDED, AGAIN, AGAIN_ROWS, SALTED = 256, 10, 3, 64
#: Bitmaps of shingles have so many words of 64 bits.
WORDS = 32
#: Bits that sketches (``shingles``) of near-equal lines differ in at most.
MOST_BITS = 30
#: Hashes, ids and keys are broadcast up to so many rows of 8 to 24 bytes; more are shuffled.
BROADCAST_ROWS = 1_500_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _content(line: Column) -> Column:
    """A line without the blanks around it; lines that neither begin nor end with one are left as they are."""
    blanks = " \t\r\x0b\x0c"
    around = reduce(lambda a, b: a | b, [f(line, F.lit(c)) for c in blanks for f in (F.startswith, F.endswith)])
    return F.when(around, F.btrim(line, F.lit(blanks))).otherwise(line)


def _split(docs: DataFrame) -> DataFrame:
    """id, line: lines with content."""
    lines = docs.select("id", F.explode(_lines(F.col("text"))).alias("line"))
    return lines.select("id", _content(F.col("line")).alias("line")).where("line <> ''")


def _bind(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``: computed once, whatever the optimizer moves."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _shingles(line: str, seed: str = "") -> str:
    """SQL for the hashed 5-character shingles of a line, with repeats; a shorter line is one.

    UTF-16 is cut in constant time; as a lambda variable it isn't copied for every shingle.
    """
    size = 2 * SHINGLE
    return _bind(f"encode({line}, 'UTF-16BE')", "b", f"if(octet_length(b) >= {size}, transform(sequence(1, octet_length(b) - {size - 1}, 2), i -> xxhash64({seed}substring(b, i, {size}))), array(xxhash64({seed}b)))")


def _arc(bands: int) -> int:
    """How far the marks of so many bands are apart on the ring of 64-bit hashes."""
    return (1 << 64) // bands


def _placed(sets: DataFrame, **bands: int) -> DataFrame:
    """``sets`` with at_x for each column x of sorted hashes: the places that keys begin at, those of all hashes or of the next after each mark.

    Sorts and searches stand outside of lambdas: there they are compiled.
    """
    marks = {x: [f"{(j - n // 2) * _arc(n)}L" for j in range(n)] for x, n in bands.items()}
    merged = sets.select("*", *[F.expr(f"if(size({x}) > {ALL_RUNS}, sort_array(concat({x}, array({', '.join(m)}))), null)").alias(f"y_{x}") for x, m in marks.items()])
    at = {x: F.array(*[F.expr(f"array_position(y_{x}, {m}) - {j + 1}") for j, m in enumerate(ms)]) for x, ms in marks.items()}
    return merged.select(*sets.columns, *[F.when(F.col(f"y_{x}").isNull(), F.expr(f"sequence(0L, size({x}) - 1L)")).otherwise(at[x]).alias(f"at_{x}") for x in marks])


def _runs(x: str, rows: int, when: str) -> str:
    """SQL for the keys of x: hashes of so many of its hashes from each place of at_x on; none unless ``when``."""
    return f"if({when}, transform(at_{x}, a -> xxhash64({rows}, {', '.join(f'{x}[cast((a + {k}) % size({x}) as int)]' for k in range(rows))})), cast(array() as array<bigint>))"


def _signed(docs: DataFrame) -> DataFrame:
    """id, h (hash of the line) and keys, of lines with content."""
    lines = _split(docs).select("id", "line", F.xxhash64("line").alias("h"), F.split("line", " ").alias("t"))
    words = lines.select("id", "h", "line", (F.char_length("line") / F.size("t")).alias("wide"), F.expr(f"array_distinct(transform(filter(t, x -> octet_length(x) >= {WORD}), x -> xxhash64(x)))").alias("t"))
    by_words = (F.size("t") >= FEW) & (F.col("wide") <= WIDER)
    by_shingles = (F.size("t") < MANY) | (F.col("wide") > WIDE)
    sides = words.select("id", "h", F.when(by_words, F.sort_array("t")).alias("w"), F.when(by_shingles, F.col("line")).alias("line"))
    raw = sides.select("id", "h", "w", F.expr(f"if(line is null, null, {_shingles('line')})").alias("s"))
    thinned = raw.select("*", F.when(F.size("s") > SAMPLE, F.expr(f"cast(ceil(log2(size(s) / {SAMPLE})) as int)")).otherwise(0).alias("times"))
    near = f"shiftright({_arc(BANDS)}L, times)"
    some = thinned.select("id", "h", "w", "s", "times", F.expr(f"array_distinct(if(times = 0, s, filter(s, r -> pmod(r, {_arc(BANDS)}L) < {near})))").alias("d"))
    whole = some.select("id", "h", "w", F.when((F.col("times") > 0) & (F.size("d") < LONG), F.array_distinct("s")).otherwise(F.col("d")).alias("d"))
    sets = whole.select("id", "h", "w", F.sort_array("d").alias("d"))
    keys = [_runs("w", WORD_ROWS, "w is not null"), _runs("d", SHORT_ROWS, f"size(d) <= {SHORT} and d is not null"), _runs("d", ROWS, f"size(d) >= {LONG}")]
    return _placed(sets, w=WORD_BANDS, d=BANDS).select("id", "h", F.expr(f"concat({', '.join(keys)})").alias("keys"))


def _again(texts: DataFrame, wanted: DataFrame, level: int) -> DataFrame:
    """h, keys of the wanted lines (h), by hashes of this level's own."""
    some = texts.join(wanted, "h", "left_semi").select("h", F.expr(_shingles("line", f"{level}, ")).alias("s"))
    sets = some.select("h", F.array_distinct("s").alias("d")).select("h", F.sort_array("d").alias("d"))
    return _placed(sets, d=AGAIN).select("h", F.expr(_runs("d", AGAIN_ROWS, "true")).alias("keys"))


def _texts(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """h, line: each wanted line (h, stored)."""
    lines = _split(docs).select(F.xxhash64("line").alias("h"), "line")
    return lines.join(bounded(wanted, rows), "h", "left_semi").dropDuplicates(["h"])


def _marked(texts: DataFrame) -> DataFrame:
    """h, n (distinct shingles), free (shingles less bits), b0, b1 and so on: the bitmap of the shingles of each line."""
    each = texts.repartition("h").select("h", F.explode(F.expr(f"array_distinct({_shingles('line')})")).alias("x"))
    placed = each.selectExpr("h", f"cast(shiftrightunsigned(x, 6) & {WORDS - 1} as int) as word", "shiftleft(1L, cast(x & 63 as int)) as bit")
    words = placed.groupBy("h", "word").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_or(bit)").alias("bits"))
    wide = [F.max(F.when(F.col("word") == i, F.col("bits"))).alias(f"b{i}") for i in range(WORDS)]
    return words.groupBy("h").agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.bit_count("bits")).alias("free"), *wide)


def _mark(side: str) -> list[Column]:
    """The marks as columns without nulls: what is compiled of their comparison stays small enough for the JVM."""
    return [F.coalesce(c, F.lit(0).cast("long")).alias(f"{c}_{side}") for c in ("n", "free", *(f"b{i}" for i in range(WORDS)))]


def _may_be_near() -> Column:
    """Whether the lines of ``_mark("u")`` and ``_mark("v")`` may reach SIMILARITY.

    A shingle in common has its bit in both bitmaps, and a line has ``free`` shingles more than bits: no more are
    common than common bits and the fewer of these.
    """
    common = " + ".join(f"bit_count(b{i}_u & b{i}_v)" for i in range(WORDS))
    return F.expr(f"least(n_u, n_v) >= {SIMILARITY}D * greatest(n_u, n_v) - 1e-6D and {1 + SIMILARITY}D * (least(free_u, free_v) + {common}) >= {SIMILARITY}D * (n_u + n_v) - 1e-6D")


def _similarity(a: str, b: str) -> str:
    """SQL for the Jaccard similarity of the sets of 5-character shingles of two lines; a shorter line is one shingle.

    0 where it can't reach SIMILARITY: the shorter line has no more shingles than positions, which may be
    too few for the longer one's set.
    """
    sided = f"if(char_length({a}) >= char_length({b}), struct({a} as l, {b} as s), struct({b} as l, {a} as s))"
    long = _bind(sided, "u", f"struct(u.s as s, array_distinct({_shingles('u.l')}) as l)")
    few = f"greatest(1, octet_length(encode(u.s, 'UTF-16BE')) / 2 - {SHINGLE - 1}) < {SIMILARITY} * size(u.l)"
    short = _bind(long, "u", f"if({few}, null, struct(array_distinct({_shingles('u.s')}) as s, u.l as l))")
    common = _bind(short, "x", "struct(size(array_intersect(x.s, x.l)) as c, size(x.s) + size(x.l) as n)")
    return f"coalesce({_bind(common, 'x', 'cast(x.c as double) / (x.n - x.c)')}, 0D)"


def _likely(marks: DataFrame, pairs: DataFrame, held: Scratch) -> DataFrame:
    """Those of the pairs (u, v: hashes of lines) that may reach SIMILARITY by their bitmaps."""
    left, right = (marks.select(F.col("h").alias(c), *_mark(c)) for c in "uv")
    likely = held.keep(pairs.join(left, "u").join(right, "v").where(_may_be_near()).select("u", "v"))
    held.drop(pairs)
    return likely


def _verified(texts: DataFrame, pairs: DataFrame, held: Scratch) -> DataFrame:
    """Those of the pairs (u, v: hashes of lines) that reach SIMILARITY exactly."""
    left, right = (texts.select(F.col("h").alias(c), F.col("line").alias(x)) for c, x in (("u", "a"), ("v", "b")))
    found = pairs.join(left, "u").join(right, "v").select("u", "v", F.expr(_similarity("a", "b")).alias("found"))
    links = held.keep(found.where(f"found >= {SIMILARITY}").select("u", "v"))
    held.drop(pairs)
    return links


def _only(texts: DataFrame, pairs: DataFrame, rows: int) -> DataFrame:
    """The texts of the pairs' lines, so that few pairs don't send all texts around; all texts if the pairs are many."""
    if pairs.count() > rows:
        return texts
    return texts.join(F.broadcast(pairs.select(F.explode(F.array("u", "v")).alias("h")).distinct()), "h", "left_semi")


def _met(bands: DataFrame, rows: int, held: Scratch) -> DataFrame:
    """key, h, low (the key's least line), n (its lines), of keys (key, h) of several lines."""
    # Nearly all keys are of one line: adding them up before the shuffle only fills memory.
    low = bands.repartition("key").groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key", "low")
    met = held.keep(low)
    found = held.keep(bands.join(bounded(met, rows), "key").select("key", "h", "low").distinct())
    held.drop(met)
    counts = held.keep(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    members = held.keep(found.join(bounded(counts, rows), "key"))
    held.drop(found, counts)
    return members


def _with_least(members: DataFrame, held: Scratch) -> DataFrame:
    """u, v: pairs of each line and the least line of a key of its."""
    return held.keep(members.where("h <> low").select(F.col("low").alias("u"), F.col("h").alias("v")).distinct())


def _apart(open_: DataFrame, marks: DataFrame) -> DataFrame:
    """u, v: likely pairs of different components within keys (key, h, low, n, component, largest), but those with the key's least line.

    Lines outside the largest component are dealt over as many salts as the key has times SALTED members, and
    all its lines are repeated for each: no task has a whole key. Pairs that can't be near-equal by their bitmaps
    are none of the join's rows.
    """
    rest = open_.where("h <> low").join(marks, "h")
    salts = F.ceil(F.col("key_n") / SALTED).cast("int")
    dealt = rest.where("component <> largest").select("key", F.col("h").alias("h_u"), F.col("component").alias("c_u"), F.pmod(F.xxhash64("h", "key"), salts).cast("int").alias("salt"), *_mark("u"))
    met = rest.select("key", F.col("h").alias("h_v"), F.col("component").alias("c_v"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), *_mark("v"))
    near = dealt.join(met, ["key", "salt"]).where((F.col("c_u") != F.col("c_v")) & _may_be_near())
    return near.select(F.least("h_u", "h_v").alias("u"), F.greatest("h_u", "h_v").alias("v")).distinct()


def _joined(texts: DataFrame, marks: DataFrame, members: DataFrame, links: DataFrame, rows: int, held: Scratch) -> DataFrame:
    """``links`` with those among the members (key, h, low, n) that the keys' least lines have missed.

    A key with few lines outside its largest component compares these with all its lines. Others are banded
    again within the key; keys that this doesn't part are compared wholly, but for pairs joined already.
    """
    level, work = 0, None
    while True:
        rounds = Scratch(texts.sparkSession)
        found = connected_components(links, held=rounds).select(F.col("node").alias("h"), "component")
        placed = rounds.keep(members.where("n > 2").join(found, "h", "left").withColumn("component", F.coalesce("component", "h")))
        sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
        parted = rounds.keep(sizes.groupBy("key").agg(F.max_by("component", "size").alias("largest"), (F.sum("size") - F.max("size")).alias("others")).where("others > 0"))
        open_ = rounds.keep(placed.join(bounded(parted, rows), "key"))
        rounds.drop(placed)
        left = parted.agg(F.sum(F.when(F.col("others") > CROWDED, F.col("others").cast("double") ** 2))).first()[0] or 0.0
        stuck = work is not None and left > work / 2
        compared = (open_ if stuck else open_.where(f"others <= {CROWDED}")).withColumnRenamed("n", "key_n")
        pairs = held.keep(_apart(compared, marks))
        links = links.union(_verified(_only(texts, pairs, rows), pairs, held))
        if stuck or not left:
            rounds.close()
            return links
        level, work = level + 1, left
        again = open_.where(f"others > {CROWDED}").select("key", "h")
        keys = _again(texts, again.select("h").distinct(), level)
        dealt = rounds.keep(again.join(keys, "h").select("h", F.col("key").alias("of"), F.explode("keys").alias("k")).select(F.xxhash64("of", "k").alias("key"), "h").distinct())
        members = _met(dealt, rows, held)
        rounds.close()
        pairs = _likely(marks, _with_least(members, held), held)
        links = links.union(_verified(_only(texts, pairs, rows), pairs, held))


def near_equal(docs: DataFrame, signed: DataFrame, rows: int = BROADCAST_ROWS, held: Scratch | None = None) -> DataFrame:
    """u, v: links between lines (hashes) of at least SIMILARITY, verified exactly; they read tables of ``held``, if given.

    They join all near-equal lines that share a key (within crowded keys: that also share one of the keys
    of each further level), though not each to each.
    """
    held = held or Scratch(docs.sparkSession)
    members = _met(signed.select("h", F.explode("keys").alias("key")), rows, held)
    release(docs.sparkSession)
    wanted = held.keep(members.select("h").distinct())
    texts = held.keep(_texts(docs, wanted, rows))
    held.drop(wanted)
    marks = held.keep(_marked(texts))
    links = _verified(texts, _likely(marks, _with_least(members, held), held), held)
    return _joined(texts, marks, members, links, rows, held)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = BROADCAST_ROWS) -> DataFrame:
    """id and ``gone``, the hashes of its lines that go wholly; only documents that lose or repeat lines. It is stored.

    Of each component of near-equal lines, the line whose first document has the smallest id stays (ties:
    the smallest hash), once, at its first place there. Lines without content aren't counted and stay.
    Rows that share an id, or have none, count as one document: equal lines in them stay alike.
    All that was stored on the way goes before this returns, so that later steps have the disk.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held, linked = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    places = held.keep(_signed(slim))
    links = near_equal(slim, places, rows, linked)
    groups = held.keep(connected_components(links, held=linked).select(F.col("node").alias("h"), "component"))
    linked.close()
    first = held.keep(places.groupBy("h").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    keepers = groups.join(first, "h").groupBy("component").agg(F.min(F.struct(F.col("first_id").isNull().alias("null"), "first_id", "h"))["h"].alias("keeper"))
    members = groups.join(keepers, "component").select("h", (F.col("h") == F.col("keeper")).alias("keeps"))
    touched = held.keep(first.join(members, "h", "left").where("copies > 1 or keeps is not null").select("h", "first_id", F.coalesce("keeps", F.lit(True)).alias("keeps")))
    held.drop(first, groups)
    seen = places.select("id", "h").join(bounded(touched, rows), "h")
    goes = ~(F.col("keeps") & F.col("id").eqNullSafe(F.col("first_id")))
    here = seen.groupBy("id", "h", goes.alias("goes")).agg(F.count(F.lit(1)).alias("places")).where("goes or places > 1")
    gone = cut(here.groupBy("id").agg(F.collect_list(F.when(F.col("goes"), F.col("h"))).alias("gone")))
    held.close()
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "line_dedup", rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with a struct column ``out``: text (without the lines that go), n_lines, n_removed (lines with content).

    A null text stays null; a text all of whose lines go becomes ''. Rows and other columns are kept; an
    input column called ``out`` is replaced. An empty table gives no rows. See ``removed_lines``.
    """
    gone = removed_lines(docs, id_col, text_col, rows).select(F.col("id").alias("_gone_id"), F.col("gone").alias("_gone"))
    # Broadcast if the hashes that go are few, so that texts stay where they are.
    if (gone.agg(F.sum(F.size("_gone") + 1)).first()[0] or 0) <= rows:
        gone = F.broadcast(gone)
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]), "left").drop("_gone_id")
    lines = joined.withColumn("_lines", _lines(F.col(text_col)))
    filled = lambda x: _content(x) != ""
    hashes = F.transform("_lines", lambda x: F.when(filled(x), F.xxhash64(_content(x))))
    marked = lines.withColumn("_h", F.when(F.col("_gone").isNotNull(), hashes))
    kept_lines = F.filter("_lines", lambda x, i: F.col("_h")[i].isNull() | (~F.array_contains(F.col("_gone"), F.col("_h")[i]) & (F.array_position(F.col("_h"), F.col("_h")[i]) == i + 1)))
    left = marked.withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept_lines))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join("_kept", "\n"))
    n_lines = F.size(F.filter("_lines", filled))
    n_kept = F.when(F.col("_gone").isNull(), n_lines).otherwise(F.size(F.filter("_kept", filled)))
    value = F.struct(text.alias("text"), n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_removed"))
    kept = [left[f"`{c}`"] for c in docs.columns if c.lower() != out.lower()]
    return left.select(*kept, value.alias(out))
