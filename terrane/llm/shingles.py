"""Shingle sets of lines in NumPy: their MinHash keys and exact similarities, a batch of lines at a time.

A shingle is a run of 5 characters (code points); a shorter line is one shingle. Its rank is a 64-bit hash
of it, and ranks lie on a ring with a mark for each of BANDS bands. A key is the hash of the ROWS least ranks
from a mark on (one-permutation MinHash): sets of similarity 0.8 share none with a chance of 0.0085.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BANDS, ROWS, SHORT_ROWS, SHINGLE = 12, 5, 4, 5
#: Sets of LONG shingles and more have keys of ROWS ranks, sets of up to SHORT (LONG = 0.8 * SHORT) of SHORT_ROWS; every run is a key up to ALL_RUNS.
LONG, SHORT, ALL_RUNS = 48, 60, 24
#: Longer lines keep the ranks next to the marks only, SAMPLE / 2 to SAMPLE of them: the runs are the same ones. Sets that turn out smaller than LONG by that aren't thinned.
SAMPLE = 192
#: Bits of a sketch.
SKETCH = 128
#: Characters that are worked on at once, a longer line by itself; lines at once by the bits left beside a rank.
CHARS, LINE_BITS = 1 << 16, 12
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ranks(lines: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rank of each shingle of each line, in order and with repeats; each one's line; the number of each line's."""
    padded = pc.utf8_rpad(lines.cast(pa.large_string()), SHINGLE, "\0")
    n = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    text = "".join(padded.to_pylist())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    count = n - (SHINGLE - 1)
    line = np.repeat(np.arange(len(n), dtype=np.int64), count)
    first = np.arange(len(line), dtype=np.int64) + (SHINGLE - 1) * line
    whole = np.zeros(max(0, len(codes) - SHINGLE + 1), dtype=np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    for j in range(SHINGLE):
        whole *= factor
        whole += codes[j : j + len(whole)]
    return _mixed(_mixed(whole[first]) ^ np.uint64(seed)), line, count


def parts(lengths: np.ndarray, most: int = 1 << LINE_BITS) -> list[tuple[int, int]]:
    """Runs (from, past) of lines of at most CHARS characters together, or of one longer line."""
    out, start, chars = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (chars + n > CHARS or i - start >= most):
            out.append((start, i))
            start, chars = i, 0
        chars += n
    return [*out, (start, len(lengths))] if len(lengths) > start else out


def _folded(rows: np.ndarray, kind: int) -> np.ndarray:
    """One hash of each row of ranks."""
    h = np.full(rows.shape[:-1], kind, dtype=np.uint64)
    for j in range(rows.shape[-1]):
        h = _mixed(h + rows[..., j])
    return h


def _signed(lines: pa.Array, seed: int) -> tuple[np.ndarray, ...]:
    """Of a few lines: sizes of their sets, how often they were halved, sketches (two words), their keys one line after the other, numbers of keys."""
    rank, line, count = ranks(lines, seed)
    n = len(count)
    times = np.where(count > SAMPLE, np.ceil(np.log2(np.maximum(count, 1) / SAMPLE)), 0).astype(np.int64)

    def sets(rank, line, times):
        """Each line's distinct ranks in order: a rank's top bits below its line."""
        near = ((np.uint64(1) << np.uint64(32)) >> times.astype(np.uint64))[line]
        kept = ((rank >> np.uint64(32)) * np.uint64(BANDS) & _LOW) < near
        s = np.sort((line[kept].astype(np.uint64) << np.uint64(64 - LINE_BITS)) | (rank[kept] >> np.uint64(LINE_BITS)))
        return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s

    of = lambda s: (s >> np.uint64(64 - LINE_BITS)).astype(np.int64)
    s = sets(rank, line, times)
    m = np.bincount(of(s), minlength=n)
    if (few := (times > 0) & (m < LONG)).any():
        times = np.where(few, 0, times)
        s = np.sort(np.concatenate((s[~few[of(s)]], sets(rank[few[line]], line[few[line]], times))))
        m = np.bincount(of(s), minlength=n)
    start = np.cumsum(m) - m
    base = (np.arange(n, dtype=np.uint64) << np.uint64(64 - LINE_BITS))[:, None]
    marks = (np.arange(BANDS, dtype=np.uint64) * np.uint64((1 << (64 - LINE_BITS)) // BANDS))[None, :]
    at = np.searchsorted(s, base | marks) - start[:, None]
    rank_bits = np.uint64((1 << (64 - LINE_BITS)) - 1)
    # One bit of the least rank in each of SKETCH bins; ranks are in order, so the first of a bin is set last.
    bits = np.zeros(n * SKETCH, dtype=np.uint8)
    bits[(of(s) * SKETCH + (s & np.uint64(SKETCH - 1)).astype(np.int64))[::-1]] = ((s >> np.uint64(7)) & np.uint64(1)).astype(np.uint8)[::-1]
    sketch = np.packbits(bits.reshape(n, SKETCH), axis=1).view(np.int64)

    def runs(which, places, rows):
        """The keys of the lines ``which`` from their ``places`` on (modulo their sizes)."""
        steps = (places[:, :, None] + np.arange(rows)) % m[which][:, None, None] + start[which][:, None, None]
        return _folded(s[steps] & rank_bits, rows)

    keys, there = np.zeros((n, BANDS + ALL_RUNS), dtype=np.uint64), np.zeros((n, BANDS + ALL_RUNS), dtype=bool)
    long, short, small = np.flatnonzero(m >= LONG), np.flatnonzero((m <= SHORT) & (m > ALL_RUNS)), np.flatnonzero(m <= ALL_RUNS)
    keys[long, :BANDS], there[long, :BANDS] = runs(long, at[long], ROWS), True
    keys[short, BANDS : 2 * BANDS], there[short, BANDS : 2 * BANDS] = runs(short, at[short], SHORT_ROWS), True
    every = np.broadcast_to(np.arange(ALL_RUNS), (len(small), ALL_RUNS))
    keys[small, BANDS:], there[small, BANDS:] = runs(small, every, SHORT_ROWS), every < m[small][:, None]
    return (m << times).astype(np.int32), times.astype(np.int32), sketch, keys[there], there.sum(axis=1)


def signed(lines: pa.Array, seed: int = 0) -> list[pa.Array]:
    """Of each line: size of its set of shingles (estimated by a sample of long lines; exact below 2 * LONG), how often the set was halved, two words of its sketch, keys.

    Sketches of sets halved alike differ in about SKETCH * (1 - similarity) / 2 bits.
    """
    found = [_signed(lines.slice(a, b - a), seed) for a, b in parts(pc.utf8_length(lines).to_numpy(zero_copy_only=False))]
    if not found:
        return [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
    sizes, times, sketch, keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))
    return [pa.array(sizes), pa.array(times), pa.array(np.ascontiguousarray(sketch[:, 0])), pa.array(np.ascontiguousarray(sketch[:, 1])), lists]


def _alike(a: pa.Array, b: pa.Array, least: float) -> np.ndarray:
    distinct = []
    for lines in (a, b):
        rank, line, _ = ranks(lines)
        s = np.sort((line.astype(np.uint64) << np.uint64(64 - LINE_BITS)) | (rank >> np.uint64(LINE_BITS)))
        distinct.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
    both = np.sort(np.concatenate(distinct))
    line = lambda s: np.bincount((s >> np.uint64(64 - LINE_BITS)).astype(np.int64), minlength=len(a))
    common = line(both[1:][both[1:] == both[:-1]])
    return common >= least * (line(both) - common)


def alike(a: pa.Array, b: pa.Array, least: float) -> np.ndarray:
    """Whether a's and b's lines, pair by pair, have sets of shingles of a Jaccard similarity of ``least`` or more.

    Shingles are told apart by 52 bits of their ranks within a pair.
    """
    n = pc.utf8_length(a).to_numpy(zero_copy_only=False) + pc.utf8_length(b).to_numpy(zero_copy_only=False)
    found = [_alike(a.slice(x, y - x), b.slice(x, y - x), least) for x, y in parts(n)]
    return np.concatenate(found) if found else np.zeros(0, dtype=bool)
