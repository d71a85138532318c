import numpy as np
from terrane.llm import tokens as T

from .conftest import nasty_rows


def by_brute_force():
    encode = T.encoder(T.load_ranks(T.VOCABULARY))
    return sorted(((i, len(encode(t or ""))) for i, t, _ in nasty_rows()), key=str)


def test_round_trip(spark, nasty):
    for block in (T.BLOCK_TOKENS, 7, 1):
        docs = nasty if block == T.BLOCK_TOKENS else nasty.where("doc_id is null or doc_id not in (9, 10)")
        want = by_brute_force() if block == T.BLOCK_TOKENS else [x for x in by_brute_force() if x[0] not in (9, 10)]
        got = sorted(((r.doc_id, r.n_tokens) for r in T.count_tokens(docs, block_tokens=block).collect()), key=str)
        assert got == want
    assert T.count_tokens(nasty.limit(0)).count() == 0


def test_flat_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = []
    for k, lengths in enumerate(([5, 0, 0, 900, 3], [2], [], [0, 4000])):
        flat = np.concatenate([np.append(rng.integers(0, 50000, n), T.END_OF_DOCUMENT) for n in lengths] or [np.zeros(0)]).astype("<u2")
        if k == 3:
            flat, lengths = np.append(flat, np.arange(17, dtype="<u2")), [*lengths, 17]
        (tmp_path / f"{k}.bin").write_bytes(flat.tobytes())
        want += [(f"{k}.bin", i, n) for i, n in enumerate(lengths)]
    for size in (2, 64, 1 << 20):
        got = T.stitch(T.scan(T.read_flat(spark, str(tmp_path), size))).collect()
        assert sorted((r.file.rsplit("/", 1)[1], r.place, r.n_tokens) for r in got) == want
